"""Hard negatives of anchors, by exact integer scores from residue-number matrix products.

Components become integers. For each of several small primes the residues of anchors and rows are
multiplied as float32 matrices; residues are centred and so small that every partial sum is an integer
below 2**24, hence exact. The signed integer scores are put together from their residues by Chinese
remaindering. There are as many primes as the largest score that the table allows needs.

Anchors and rows are dealt into blocks of bounded size by a hash; a task multiplies one block of
anchors with one block of rows and passes on a few candidates per anchor. A first pass finds each anchor's
positives, a second one the best rows inside the score window under each positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.centroids import cells, finite, matrix
from newsloom.plans.staging import staged

# Rows and anchors in a block, on average; anchors that are multiplied at once.
BLOCK_ROWS = 4096
TILE = 256

# Components in a float32 product, and the exact range of float32.
_DEPTH = 64
_EXACT = 1 << 24
_MOST_PRIMES = 6


def _primes() -> list[int]:
    """Greatest primes whose centred residues keep a product of ``_DEPTH`` components exact."""
    most = 2 * int((_EXACT / _DEPTH) ** 0.5) + 1
    sieve = np.ones(most + 1, bool)
    for n in range(2, int(most**0.5) + 1):
        sieve[n * n :: n] = False
    fit = [p for p in np.flatnonzero(sieve)[:1:-1].tolist() if _DEPTH * ((p - 1) // 2) ** 2 < _EXACT]
    return fit[:_MOST_PRIMES]


def primes_for(bound: int) -> list[int]:
    """As few primes as represent all integers from ``-bound`` to ``bound``."""
    product, chosen = 1, []
    for prime in _primes():
        if product > 2 * bound:
            break
        chosen.append(prime)
        product *= prime
    if product <= 2 * bound:
        raise ValueError("the components are too large for exact scores in 64 bits")
    return chosen


def _residues(values: np.ndarray, prime: int) -> np.ndarray:
    """Residues from -(prime - 1) / 2 to (prime - 1) / 2."""
    half = prime // 2
    return ((values + half) % prime - half).astype(np.float32)


def exact_products(left: np.ndarray, right: np.ndarray, primes: list[int]) -> np.ndarray:
    """``left @ right.T`` of integer matrices, exactly, where the primes cover the result."""
    per_prime = []
    for prime in primes:
        a, b = _residues(left, prime), _residues(right, prime)
        total = np.zeros((len(a), len(b)), np.int64)
        for k in range(0, a.shape[1], _DEPTH):
            total += (a[:, k : k + _DEPTH] @ b[:, k : k + _DEPTH].T).astype(np.int64)
        per_prime.append(total % prime)
    # Mixed-radix digits: each prime's digit is what the smaller part leaves of its residue.
    value, weight = per_prime[0].copy(), primes[0]
    for prime, residue in zip(primes[1:], per_prime[1:], strict=True):
        digit = (residue - value) % prime * pow(weight, -1, prime) % prime
        value += digit * weight
        weight *= prime
    return np.where(value > weight // 2, value - weight, value)


def _side(rows: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers, labels and row numbers of a block."""
    numbers = rows.column("row").to_numpy()
    return matrix(rows.column("cells"), dims), rows.column("label").to_numpy(), numbers


def _tiles(anchors: pa.Table, rows: pa.Table, primes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first anchor, scores, same label, same row) of some anchors against all rows."""
    dims = anchors.column("dims")[0].as_py()
    left, left_label, left_row = _side(anchors, dims)
    right, right_label, right_row = _side(rows, dims)
    for first in range(0, len(left), TILE):
        part = slice(first, first + TILE)
        scores = exact_products(left[part], right, primes)
        alike = left_label[part, None] == right_label[None, :]
        yield first, scores, alike, left_row[part, None] == right_row[None, :]


def _by_id(rows: pa.Table) -> pa.Table:
    """Rows by rising id, nulls last: of equal scores the first is the one wanted."""
    return rows.sort_by([("vec_id", "ascending")])


def _positives(primes: list[int], wanted: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        least = np.iinfo(np.int64).min
        at, who, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(anchors) and len(rows):
            rows = _by_id(rows)
            for first, scores, alike, itself in _tiles(anchors, rows, primes):
                scores[~alike | itself] = least
                every = np.arange(len(scores))
                for _ in range(wanted):
                    # The first of equal maxima has the smaller id.
                    best = scores.argmax(axis=1)
                    value = scores[every, best]
                    found = value > least
                    at.append(first + every[found])
                    who.append(best[found])
                    score.append(value[found])
                    scores[every, best] = least
        at, who = np.concatenate(at), np.concatenate(who)
        return pa.table(
            {
                "anchor_row": anchors.column("row").take(pa.array(at)),
                "positive_id": rows.column("vec_id").take(pa.array(who)),
                "positive_score": pa.array(np.concatenate(score)),
            }
        )

    return find


def _negatives(primes: list[int], wanted: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def find(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        at, place, who, score = [], [], [], []
        if len(anchors) and len(rows):
            rows = _by_id(rows)
            tops = anchors.column("tops").to_pylist()
            for first, scores, alike, _ in _tiles(anchors, rows, primes):
                for number in range(len(scores)):
                    line, top = scores[number], tops[first + number]
                    # Windows in exact integers: low * positive <= high * score <= high * positive.
                    ends = [(-(-low * t // high), t) for t in top]
                    inside = ~alike[number] & (line >= min(a for a, _ in ends)) & (line <= max(b for _, b in ends))
                    open_rows = np.flatnonzero(inside)
                    open_rows = open_rows[np.argsort(-line[open_rows], kind="stable")]
                    falling = -line[open_rows]
                    for k, (least, most) in enumerate(ends):
                        start = int(np.searchsorted(falling, -most, side="left"))
                        upto = int(np.searchsorted(falling, -least, side="right"))
                        for row in open_rows[start : min(upto, start + wanted)]:
                            at.append(first + number)
                            place.append(k)
                            who.append(int(row))
                            score.append(int(line[row]))
        return pa.table(
            {
                "anchor_row": anchors.column("row").take(pa.array(at, pa.int64())),
                "place": pa.array(place, pa.int32()),
                "negative_id": rows.column("vec_id").take(pa.array(who, pa.int64())),
                "negative_score": pa.array(score, pa.int64()),
            }
        )

    return find


def _dealt(rows: DataFrame, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
    """Rows with their own block and once for every block of the other side."""
    others = F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1)))
    block = F.pmod(F.xxhash64("row"), F.lit(own_blocks)).cast("int")
    return rows.withColumn(own, block).withColumn(other, others)


def hard_negatives(
    vectors: DataFrame,
    *,
    anchors: str = "vec_id % 100 = 0",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """For each anchor and each of its positives the best other-label rows inside the score window.

    ``vectors``: ``vec_id, label, embedding``. The score of a row is its integer inner product with the
    anchor; ties by smaller id, null ids last. Positives are the first ``positives`` other rows of the
    anchor's label; negatives the first ``negatives`` rows of other labels with
    ``low * positive_score <= high * negative_score <= high * positive_score``.
    Rows with a null label, a null or empty vector or a null or non-finite component take no part; vectors of
    another length have no score with the anchor. Rows are told apart by row, not by id: a repeated row is
    another row. Other columns are ignored; an empty table gives no row. Components too large for exact
    scores are an error.
    """
    whole = finite(F.col("embedding")) & (F.size("embedding") > 0)
    kept = vectors.filter(F.col("label").isNotNull() & whole).select(
        F.monotonically_increasing_id().alias("row"),
        "vec_id",
        F.col("label").cast("bigint").alias("label"),
        cells(F.col("embedding"), scale).alias("cells"),
        F.size("embedding").alias("dims"),
        F.coalesce(F.expr(anchors), F.lit(False)).alias("is_anchor"),
    )
    kept = staged(kept)
    largest = F.max(F.greatest(F.abs(F.array_max("cells")), F.abs(F.array_min("cells"))))
    facts = kept.agg(
        F.count("*").alias("rows"),
        F.count_if("is_anchor").alias("anchors"),
        F.coalesce(largest, F.lit(0)).alias("largest"),
        F.coalesce(F.max("dims"), F.lit(0)).alias("dims"),
    ).first()
    if facts.largest < 0:  # the least long has no absolute value
        raise ValueError("the components are too large for exact scores in 64 bits")
    primes = primes_for(facts.dims * facts.largest**2)
    row_blocks = max(1, -(-facts.rows // BLOCK_ROWS))
    anchor_blocks = max(1, -(-facts.anchors // BLOCK_ROWS))

    kept = kept.withColumn("cells", F.col("cells").cast("array<int>"))
    keys = ["dims", "anchor_block", "row_block"]
    every = _dealt(kept.drop("is_anchor"), "row_block", row_blocks, "anchor_block", anchor_blocks)
    asked = kept.filter("is_anchor").drop("is_anchor")

    def meet(left: DataFrame, find: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        left = _dealt(left, "anchor_block", anchor_blocks, "row_block", row_blocks)
        return left.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInArrow(find, schema)

    id_type = kept.schema["vec_id"].dataType.simpleString()
    found = meet(
        asked, _positives(primes, positives), f"anchor_row bigint, positive_id {id_type}, positive_score bigint"
    )
    order = Window.partitionBy("anchor_row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    best = found.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < positives)
    best = staged(best)
    # At most ``positives`` entries an anchor.
    tops = best.groupBy(F.col("anchor_row").alias("row")).agg(
        F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("tops")
    )
    asking = staged(asked.join(tops.withColumn("tops", F.col("tops.positive_score")), "row"))
    found = meet(
        asking,
        _negatives(primes, negatives, low, high),
        f"anchor_row bigint, place int, negative_id {id_type}, negative_score bigint",
    )
    order = Window.partitionBy("anchor_row", "place").orderBy(
        F.desc("negative_score"), F.asc_nulls_last("negative_id")
    )
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named = best.join(asked.select(F.col("row").alias("anchor_row"), F.col("vec_id").alias("anchor_id")), "anchor_row")
    return ranked.join(named, ["anchor_row", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
