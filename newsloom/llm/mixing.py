"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by membership pattern (the set of sources that hold them), a small table.
A flow routes the words of each pattern to its sources' targets; every further copy of a pattern costs
more than the one before, so repetition is spread before it grows. Which documents of a pattern are
taken is settled by a seeded order: whole copies for all, one more for those first in the order.
The cut in that order is found by running sums over hash cells, three levels deep, so that no pattern is
gathered in one task.
"""

from __future__ import annotations

import math
from collections import deque
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from newsloom.llm.texts import free_name
from newsloom.plans.staging import staged

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2
SEED = "mix"
MOST_PATTERNS = 10_000
_CELL = 3  # hex digits of the seeded order per level


class Mixed(NamedTuple):
    """Sources with their targets, and a small table of what is taken of each pattern.

    ``plan`` has ``name`` (the pattern), ``whole`` (copies of all its documents) and ``cut``: documents up to
    this key, in the seeded order, are taken once more (null: none).
    """

    targets: dict[str | None, float]
    plan: DataFrame
    sources: str
    text: str
    key: str
    seed: str
    most: int


def targets(sizes: dict, weights: dict, total: float, most: float = MOST_COPIES) -> dict:
    """Shares of ``total`` by weight; what exceeds ``most`` times a source's size is shared again."""
    out = dict.fromkeys(sizes, 0.0)
    free = {s for s in sizes if weights[s] > 0}
    left = total
    while free:
        level = left / sum(weights[s] for s in sorted(free, key=_null_last))
        full = {s for s in free if level * weights[s] > most * sizes[s]}
        if not full:
            for s in free:
                out[s] = level * weights[s]
            break
        for s in sorted(full, key=_null_last):
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= full
    return out


def _null_last(source) -> tuple:
    return (source is None, source or "")


def flow(capacity: list[float], members: list[list[int]], demand: list[float], copies: int) -> list[list[float]]:
    """Words that each pattern sends to each of its sources, at least cost.

    A pattern sends at most ``copies`` times its capacity; its k-th copy costs k - 1 a word. Successive
    cheapest paths on the residual graph, found by relaxing from a queue.
    """
    patterns, sources = len(capacity), len(demand)
    start, end = patterns + sources, patterns + sources + 1
    graph: list[list[int]] = [[] for _ in range(end + 1)]
    to, room, cost = [], [], []

    def edge(a: int, b: int, size: float, price: float) -> None:
        for x, y, r, c in ((a, b, size, price), (b, a, 0.0, -price)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(c)

    for p in range(patterns):
        for k in range(copies):
            edge(start, p, capacity[p], float(k))
    first = len(to)
    for p in range(patterns):
        for s in members[p]:
            edge(p, patterns + s, math.inf, 0.0)
    last = len(to)
    for s in range(sources):
        edge(patterns + s, end, demand[s], 0.0)
    while True:
        far = [math.inf] * (end + 1)
        by = [-1] * (end + 1)
        far[start] = 0.0
        queue, queued = deque([start]), {start}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in graph[a]:
                if room[e] > 1e-9 and far[a] + cost[e] < far[to[e]] - 1e-12:
                    far[to[e]], by[to[e]] = far[a] + cost[e], e
                    if to[e] not in queued:
                        queued.add(to[e])
                        queue.append(to[e])
        if far[end] == math.inf:
            break
        sent, at = math.inf, end
        while at != start:
            sent = min(sent, room[by[at]])
            at = to[by[at] ^ 1]
        at = end
        while at != start:
            room[by[at]] -= sent
            room[by[at] ^ 1] += sent
            at = to[by[at] ^ 1]
    out, e = [], first
    for p in range(patterns):
        out.append([room[e + 2 * k + 1] for k in range(len(members[p]))])
        e += 2 * len(members[p])
    assert e == last
    return out


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _cuts(units: DataFrame, extra: DataFrame) -> DataFrame:
    """``pattern, cut``: the last key, in order, whose words are still wanted beyond whole copies.

    ``units`` has ``pattern, key, size`` and ``extra`` a row per pattern with the words ``wanted``. A key is
    taken while half of its words fit. Each level sums cells of keys, and looks on in the one cell where the
    wanted words end.
    """
    here = extra.select("pattern", "wanted", F.lit("").alias("prefix"))
    for level in (1, 2):
        cell = F.substring("key", 1, _CELL * level)
        inside = units.join(F.broadcast(here), "pattern").filter(F.col("key").startswith(F.col("prefix")))
        sums = inside.groupBy("pattern", cell.alias("cell"), "wanted").agg(F.sum("size").alias("size"))
        upto = Window.partitionBy("pattern").orderBy("cell")
        placed = sums.withColumn("after", F.sum("size").over(upto))
        # The first cell that reaches the wanted words, or the last one.
        ends = placed.withColumn("more", F.lead("cell").over(upto).isNotNull())
        ends = ends.filter((F.col("after") - F.col("size") < F.col("wanted")) | (F.col("after") == F.col("size")))
        ends = ends.groupBy("pattern").agg(F.max(F.struct("cell", "after", "size", "wanted")).alias("end"))
        here = staged(ends.select(
            "pattern", (F.col("end.wanted") - F.col("end.after") + F.col("end.size")).alias("wanted"),
            F.col("end.cell").alias("prefix"),
        ))
    inside = units.join(F.broadcast(here), "pattern").filter(F.col("key").startswith(F.col("prefix")))
    sums = inside.groupBy("pattern", "key", "prefix", "wanted").agg(F.sum("size").alias("size"))
    upto = Window.partitionBy("pattern").orderBy("key")
    placed = sums.withColumn("after", F.sum("size").over(upto))
    taken = placed.filter(F.col("after") - F.col("size") / 2 <= F.col("wanted"))
    # Cells before the one looked at are taken whole; a blank sorts before every digit.
    return here.join(taken.groupBy("pattern").agg(F.max("key").alias("key")), "pattern", "left").select(
        "pattern", F.coalesce("key", "prefix").alias("cut")
    )


def _held(docs: DataFrame, sources: str) -> Column:
    """The pattern of a row: its distinct sources in order."""
    kind = docs.schema[sources].dataType
    if not isinstance(kind, T.ArrayType):
        return F.array(F.col(sources))
    held = F.array_sort(F.array_distinct(F.coalesce(F.col(sources), F.array().cast(kind))))
    return F.when(F.size(held) == 0, F.array(F.lit(None).cast("string"))).otherwise(held)


def _name(held: Column) -> Column:
    return F.to_json(F.struct(held.alias("held")), {"ignoreNullFields": "false"})


def _seeded(seed: str, key: str, text: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"), F.col(text)).cast("binary"))


def mix(
    docs: DataFrame,
    sources: str = "source",
    text: str = "text",
    key: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
    seed: str = SEED,
) -> Mixed:
    """What to take so that sources come near their targets.

    ``sources`` is a string column, or an array of the sources that hold the document. Sources in code
    point order, null last, weigh ``weights``, repeating; they share ``share`` times all words, at most
    ``most`` times a source's own. A document is taken whole, at most ``most`` times. Rows that are equal in
    id and text are taken alike; a document without words has none to take; a repeated or missing source
    in an array counts once (an empty or null array: the null source). More than ``MOST_PATTERNS`` patterns
    are an error, as their table comes to the driver. An empty table has no sources.
    """
    spark = docs.sparkSession
    held = _held(docs, sources)
    rows = staged(docs.select(
        word_count(F.col(text)).alias("size"), held.alias("held"), _seeded(seed, key, text).alias("key")
    ))
    patterns = rows.groupBy("held").agg(F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of sources")
    patterns = sorted(patterns, key=lambda p: [_null_last(s) for s in p.held])
    names = sorted({s for p in patterns for s in p.held}, key=_null_last)
    sizes = {s: sum(p["size"] for p in patterns if s in p.held) for s in names}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    words = sum(p["size"] for p in patterns)
    wanted = targets(sizes, weight, share * words, most)
    place = {s: i for i, s in enumerate(names)}
    sent = flow(
        [float(p["size"]) for p in patterns], [[place[s] for s in p.held] for p in patterns],
        [wanted[s] for s in names], most,
    )
    plan = []
    for i, (p, parts) in enumerate(zip(patterns, sent, strict=True)):
        total = sum(parts)
        whole = min(most, int(total / p["size"] + 1e-9)) if p["size"] else 0
        plan.append((i, list(p.held), whole, float(max(0.0, total - whole * p["size"]))))
    # At most MOST_PATTERNS rows, here and below.
    plans = spark.createDataFrame(plan, "pattern int, held array<string>, whole int, wanted double")
    plans = staged(plans.select("pattern", _name(F.col("held")).alias("name"), "whole", "wanted").coalesce(1))
    units = rows.filter("size > 0").withColumn("name", _name(F.col("held")))
    units = units.join(F.broadcast(plans), "name").filter("wanted > 0").select("pattern", "key", "size")
    cuts = staged(_cuts(units, plans.filter("wanted > 0").select("pattern", "wanted")))
    table = staged(plans.join(F.broadcast(cuts), "pattern", "left").select("name", "whole", "cut").coalesce(1))
    return Mixed(wanted, table, sources, text, key, seed, most)


def taken(docs: DataFrame, mixed: Mixed, size: str = "size", copies: str = "copies") -> DataFrame:
    """All rows and columns, with the words of each text and how often it is taken, under free names."""
    size, copies = free_name(docs.columns, size), free_name(docs.columns, copies)
    # One name per added column, none of which the table has.
    name, whole, cut = (free_name(docs.columns, x) for x in ("_name", "_whole", "_cut"))
    plan = F.broadcast(mixed.plan.select(F.col("name").alias(name), F.col("whole").alias(whole), F.col("cut").alias(cut)))
    placed = docs.withColumn(name, _name(_held(docs, mixed.sources))).join(plan, name)
    more = F.coalesce(_seeded(mixed.seed, mixed.key, mixed.text) <= F.col(cut), F.lit(False)).cast("int")
    often = F.least(F.col(whole) + more, F.lit(mixed.most))
    placed = placed.withColumn(size, word_count(F.col(mixed.text)))
    placed = placed.withColumn(copies, F.when(F.col(size) > 0, often).otherwise(0))
    return placed.select(*docs.columns, size, copies)


def mixture(docs: DataFrame, mixed: Mixed) -> DataFrame:
    """The mix itself: every row as often as it is taken, columns as they were."""
    copies = free_name(docs.columns, "copies")
    often = taken(docs, mixed)
    repeated = often.filter(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return repeated.select(*docs.columns)
