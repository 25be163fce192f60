"""Cosine similarity to any number of keyword vectors.

``similarity`` sends a checked number of keywords to every task. Here the keywords are a table: they are dealt
into blocks of like directions around pivots, a vector is sent to the blocks that the angles to the pivots
cannot rule out, and each group of vectors meets one block in one matrix product.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.positions import number_rows
from newsloom.operators.similarity import _similarities, _unit_rows
from newsloom.plans.staging import staged

BLOCK_KEYWORDS = 4096
GROUP_ROWS = 8192
PIVOTS = 64
MOST_BLOCKS = 262_144

# Rounding of angles never rules a block out.
_SLACK = 1e-6
_SLICE_CELLS = 4_000_000


class _Blocks(NamedTuple):
    """Pivots, and per block and pivot the least and greatest angle of its keywords, ordered by block."""

    pivots: np.ndarray
    block: np.ndarray
    pivot: np.ndarray
    least: np.ndarray
    most: np.ndarray


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _chained(pivots: np.ndarray) -> np.ndarray:
    """Pivots in an order in which each is followed by the nearest of the rest, so that a block is of like pivots."""
    cosines = pivots @ pivots.T
    order = [0]
    left = set(range(1, len(pivots)))
    while left:
        order.append(max(left, key=lambda p: (cosines[order[-1], p], -p)))
        left.remove(order[-1])
    return pivots[order]


def _nearest(pivots: np.ndarray):
    @F.arrow_udf("struct<pivot: int, angle: double>")
    def nearest(vectors: pa.Array) -> pa.Array:
        cosines, _ = _similarities(vectors, pivots)
        pivot = cosines.argmax(axis=1)
        angle = _angles(cosines[np.arange(len(pivot)), pivot])
        return pa.StructArray.from_arrays([pa.array(pivot, pa.int32()), pa.array(angle)], ["pivot", "angle"])

    return nearest


def _bounds(cosines: np.ndarray, blocks: _Blocks) -> np.ndarray:
    """Greatest cosine that a keyword of each block can have, by the triangle inequality of angles."""
    angles = _angles(cosines)[:, blocks.pivot]
    gap = np.maximum(np.maximum(angles - blocks.most, blocks.least - angles), 0.0)
    _, starts = np.unique(blocks.block, return_index=True)
    return np.maximum.reduceat(np.cos(gap), starts, axis=1)


def _slices(cosines: np.ndarray, blocks: _Blocks):
    step = max(1, _SLICE_CELLS // len(blocks.block))
    for start in range(0, len(cosines), step):
        yield start, _bounds(cosines[start : start + step], blocks)


def _promising(blocks: _Blocks):
    """The block that may hold the nearest keyword; null for a vector that cannot be compared."""

    @F.arrow_udf("int")
    def promising(vectors: pa.Array) -> pa.Array:
        cosines, known = _similarities(vectors, blocks.pivots)
        numbers = np.unique(blocks.block)
        out = np.zeros(len(known), dtype=np.int32)
        best = [numbers[bounds.argmax(axis=1)] for _, bounds in _slices(cosines, blocks)]
        out[known] = np.concatenate(best) if best else []
        return pa.array(out, mask=~known)

    return promising


def _reaching(blocks: _Blocks):
    """Blocks that may hold a keyword of at least a similarity, all but the one already seen."""

    @F.arrow_udf("array<int>")
    def reaching(vectors: pa.Array, least: pa.Array, seen: pa.Array) -> pa.Array:
        cosines, known = _similarities(vectors, blocks.pivots)
        numbers = np.unique(blocks.block)
        floor = least.fill_null(2.0).to_numpy(zero_copy_only=False)[known] - _SLACK
        skipped = seen.fill_null(-1).to_numpy(zero_copy_only=False)[known]
        lists: list = []
        for start, bounds in _slices(cosines, blocks):
            end = start + len(bounds)
            reached = bounds >= floor[start:end, None]
            reached &= numbers[None, :] != skipped[start:end, None]
            lists.extend(numbers[row] for row in reached)
        rows: list = [None] * len(known)
        for at, found in zip(np.flatnonzero(known), lists, strict=True):
            rows[at] = found
        return pa.array(rows, pa.list_(pa.int32()))

    return reaching


def _dealt(keywords: DataFrame, name: str, vector: str, block: int) -> tuple[DataFrame, _Blocks]:
    """``block, keyword, vec`` and what the driver knows of the blocks: pivots and a row per block and pivot."""
    finite = F.forall(F.col("vec"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    wanted = keywords.select(
        F.col(name).cast("string").alias("keyword"), F.col(vector).cast("array<double>").alias("vec")
    ).filter((F.size("vec") > 0) & finite)
    lengths = [row.n for row in wanted.select(F.size("vec").alias("n")).distinct().limit(2).collect()]
    if not lengths:
        raise ValueError("the keyword set is empty")
    if len(lengths) > 1:
        raise ValueError(f"keyword vectors differ in length: {sorted(lengths)}")
    chosen = wanted.orderBy(F.xxhash64("vec"), "keyword").select("vec").limit(PIVOTS).collect()
    pivots = _chained(_unit_rows(np.array([row.vec for row in chosen], dtype=np.float64)))
    near = wanted.withColumn("near", _nearest(pivots)(F.col("vec"))).select("keyword", "vec", "near.*")
    numbered = number_rows(near, ["pivot", "angle", "keyword"])
    placed = numbered.withColumn("block", F.floor((F.col("position") - 1) / block).cast("int"))
    spans = placed.groupBy("block", "pivot").agg(F.min("angle").alias("least"), F.max("angle").alias("most"))
    rows = spans.limit(MOST_BLOCKS + 1).collect()
    if len(rows) > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} blocks; raise the keywords of a block")
    rows.sort(key=lambda row: (row.block, row.pivot))
    columns = [np.array([row[c] for row in rows]) for c in ("block", "pivot", "least", "most")]
    return placed.select("block", "keyword", "vec"), _Blocks(pivots, *columns)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks()
    return _unit_rows(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1))


def _products(left: pa.Table, right: pa.Table):
    """Similarities of a group's vectors to a block's keywords, in slices of rows."""
    if left.num_rows and right.num_rows:
        keywords = _matrix(right["vec"]).T
        rows = _matrix(left["vec"])
        step = max(1, _SLICE_CELLS // keywords.shape[1])
        for start in range(0, len(rows), step):
            yield start, rows[start : start + step] @ keywords


def _best(left: pa.Table, right: pa.Table) -> pa.Table:
    best = [scores.max(axis=1) for _, scores in _products(left, right)]
    rows = left["_row"] if best else left["_row"].slice(0, 0)
    found = np.concatenate(best) if best else np.zeros(0)
    return pa.table({"_row": rows, "similarity": pa.array(found, pa.float64())})


def _reached(threshold: float):
    def reached(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for start, scores in _products(left, right):
            row, keyword = np.nonzero(scores >= threshold)
            names = right["keyword"].take(pa.array(keyword))
            rows = left["_row"].take(pa.array(row + start))
            parts.append(pa.table({"_row": rows, "keyword": names, "similarity": pa.array(scores[row, keyword])}))
        if parts:
            return pa.concat_tables(parts)
        empty = {"_row": left["_row"].slice(0, 0), "keyword": right["keyword"].slice(0, 0)}
        return pa.table(empty | {"similarity": pa.array([], pa.float64())})

    return reached


def _meet(visits: DataFrame, rows: DataFrame, keywords: DataFrame, function, schema: str, group: int) -> DataFrame:
    """The function over each block and every group of about ``group`` vectors that visit it.

    A block that many vectors visit is copied to each of their groups, so no task holds all its visitors.
    """
    visits = staged(visits)
    # One row per block.
    parts = visits.groupBy("block").agg(F.ceil(F.count("*") / group).alias("parts"))
    left = visits.join(F.broadcast(parts), "block")
    left = left.select("_row", "block", F.expr("pmod(xxhash64(_row), parts)").alias("part"))
    left = left.join(rows.select("_row", "vec"), "_row")
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")
    right = keywords.join(F.broadcast(parts), "block").select("block", "keyword", "vec", copies)
    pairs = left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))
    return pairs.applyInArrow(function, schema)


def _tagged(vectors: DataFrame, vector: str) -> DataFrame:
    return staged(vectors.select("*", F.col(vector).alias("vec"), F.monotonically_increasing_id().alias("_row")))


def score_many(
    vectors: DataFrame,
    keywords: DataFrame,
    *,
    vector: str = "embedding",
    keyword: str = "keyword",
    keyword_vector: str = "embedding",
    block: int = BLOCK_KEYWORDS,
    group: int = GROUP_ROWS,
) -> DataFrame:
    """``vectors`` with ``similarity``, the best cosine to any keyword, as ``score_vectors`` gives it.

    A vector first meets the block that may hold its nearest keyword, then only the blocks whose bound is not
    below what it found. Vectors that are null, of another length or with a null component have no score.
    Keywords that are null or have a component that is null or not finite are none; an empty set and
    keywords of different lengths are errors.
    """
    dealt, blocks = _dealt(keywords, keyword, keyword_vector, block)
    rows = _tagged(vectors, vector)
    schema = "_row long, similarity double"
    home = rows.select("_row", _promising(blocks).asNondeterministic()(F.col("vec")).alias("block")).filter("block IS NOT NULL")
    home = staged(home)
    first = staged(_meet(home, rows, dealt, _best, schema, group))
    known = rows.select("_row", "vec").join(first, "_row").join(home, "_row")
    others = _reaching(blocks)(F.col("vec"), F.col("similarity"), F.col("block"))
    rest = _meet(known.select("_row", F.explode(others).alias("block")), rows, dealt, _best, schema, group)
    best = first.unionByName(rest).groupBy("_row").agg(F.max("similarity").alias("similarity"))
    return rows.drop("vec").join(best, "_row", "left").drop("_row")


def match_many(
    vectors: DataFrame,
    keywords: DataFrame,
    threshold: float,
    *,
    vector: str = "embedding",
    keyword: str = "keyword",
    keyword_vector: str = "embedding",
    block: int = BLOCK_KEYWORDS,
    group: int = GROUP_ROWS,
) -> DataFrame:
    """A row of ``vectors`` with ``keyword`` and ``similarity`` for every keyword at or above the threshold.

    Blocks that cannot reach the threshold are skipped. Rows and keywords are judged as in ``score_many``.
    """
    dealt, blocks = _dealt(keywords, keyword, keyword_vector, block)
    rows = _tagged(vectors, vector)
    reached = _reaching(blocks)(F.col("vec"), F.lit(float(threshold)), F.lit(-1))
    visits = rows.select("_row", F.explode(reached).alias("block"))
    schema = "_row long, keyword string, similarity double"
    pairs = _meet(visits, rows, dealt, _reached(threshold), schema, group)
    return rows.drop("vec").join(pairs, "_row").drop("_row")
