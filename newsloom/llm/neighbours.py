"""Approximate nearest neighbours by inner product: an NN-descent graph, searched greedily.

Equal vectors are one node. Nodes carry their vector as 16-bit floats, with one more component that
gives all the same length, so that the largest inner product is the nearest node. The graph starts
from blocks of nodes that fall on the same side of random planes. Then, round by round, a join brings
every node's neighbours (either way) together, each looks at the others as possible neighbours, and
keeps the nearest, until few change. A search starts at the query's own node, if it has one, and at
a few fixed nodes; in every round it expands the nearest nodes not yet expanded by a join with the graph. Last,
the candidates are scored in double precision on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.texts import mixed
from newsloom.plans.staging import staged

DEGREE = 32
ROUNDS = 6
TABLES = 4
BLOCK = 256
OFFERS = 10
ENOUGH = 0.01
LIST = 192
BEAM = 48
ENTRIES = 16
SEARCH_ROUNDS = 30


class Index(NamedTuple):
    """Nodes (``node, vector, ids``), their codes (``node, code``), and links (``node, near``).

    A node has the ``copies`` least ids of its vector.
    """

    nodes: DataFrame
    codes: DataFrame
    links: DataFrame
    longest: float
    copies: int


def usable(vector: Column, length: int) -> Column:
    """Whether a vector has the length, no null or non-finite component, and is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == length) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _as_doubles(vector: Column) -> Column:
    # Adding zero turns a negative zero into zero.
    return F.transform(vector.cast("array<double>"), lambda x: x + F.lit(0.0))


def _coded(rows: DataFrame, longest: float, asked: bool = False) -> DataFrame:
    """``node, code`` from ``node, vector``. A query has no component beyond its own."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            v = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            rest = np.sqrt(np.maximum(longest**2 - (v**2).sum(axis=1), 0))
            if asked:
                rest[:] = 0
            codes = (np.column_stack([v, rest]) / longest).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([c.tobytes() for c in codes], pa.binary())], ["node", "code"]
            )

    return rows.select("node", "vector").mapInArrow(run, "node bigint, code binary")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds whole runs of the key, by which they are sorted."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if kept and cut == 0 and kept[-1].column(key)[0].as_py() != keys[0]:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
            kept = []
        if cut:
            whole = pa.Table.from_batches([*kept, batch.slice(0, cut)]).combine_chunks()
            yield from whole.to_batches()
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


def _edges_of(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _codes_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(len(column), -1).astype(np.float32)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    sizes = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, kind))


_OFFER = "node bigint, ids array<bigint>, sims array<float>"


def _local_join(groups: DataFrame, offers: int) -> DataFrame:
    """For each member of a group the nearest others that it may want as neighbours.

    ``groups`` has ``center, member, code, fresh, least``. Two members are compared if one of them is new to
    the group's node; only what is nearer than a member's farthest neighbour is offered to it.
    """

    def run(batches):
        for batch in _runs(batches, "center"):
            member = batch.column("member").to_numpy()
            fresh = batch.column("fresh").to_numpy(zero_copy_only=False).astype(bool)
            least = batch.column("least").to_numpy()
            codes = _codes_of(batch.column("code"))
            edges = _edges_of(batch.column("center").to_numpy())
            nodes, ids, sims = [], [], []
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if z - a < 2 or not fresh[a:z].any():
                    continue
                near = codes[a:z] @ codes[a:z].T
                good = (fresh[a:z, None] | fresh[None, a:z]) & (near > least[a:z, None])
                good &= member[a:z, None] != member[None, a:z]
                near = np.where(good, near, -np.inf)
                take = min(offers, z - a)
                best = np.argpartition(-near, take - 1, axis=1)[:, :take]
                value = np.take_along_axis(near, best, axis=1)
                for row in np.flatnonzero((value > -np.inf).any(axis=1)):
                    real = value[row] > -np.inf
                    nodes.append(member[a + row])
                    ids.append(member[a + best[row][real]])
                    sims.append(value[row][real])
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(nodes, np.int64)), _lists(ids, pa.int64()), _lists(sims, pa.float32())],
                    ["node", "ids", "sims"],
                )

    dealt = groups.select("center", "member", "code", "fresh", "least")
    return dealt.repartition("center").sortWithinPartitions("center").mapInArrow(run, _OFFER)


def _merged(graph: DataFrame | None, offers: DataFrame, degree: int) -> DataFrame:
    """``node, ids, sims, fresh``: each node's nearest among its neighbours and what it was offered."""

    def run(batches):
        for batch in _runs(batches, "node"):
            keys = batch.column("node").to_numpy()
            old = batch.column("old").to_numpy(zero_copy_only=False).astype(bool)
            ids_at = batch.column("ids").offsets.to_numpy()
            ids = batch.column("ids").values.to_numpy()
            sims = batch.column("sims").values.to_numpy()
            out: list[list] = [[], [], [], []]
            edges = _edges_of(keys)
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                part = slice(ids_at[a], ids_at[z])
                here, near = ids[part], sims[part]
                was = np.repeat(old[a:z], np.diff(ids_at[a : z + 1]))
                order = np.lexsort((~was, here))  # what was there before comes first
                here, near, was = here[order], near[order], was[order]
                first = np.ones(len(here), bool)
                first[1:] = here[1:] != here[:-1]
                here, near, was = here[first], near[first], was[first]
                # Equally near ones are drawn by lot, else all nodes of a dense group would choose the same.
                lot = mixed((here ^ keys[a]).view(np.uint64))
                best = np.lexsort((lot, -near))[:degree]
                for column, value in zip(out, (keys[a], here[best], near[best], ~was[best]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(out[0], np.int64)), _lists(out[1], pa.int64()), _lists(out[2], pa.float32()),
                 _lists(out[3], pa.bool_())],
                ["node", "ids", "sims", "fresh"],
            )

    rows = offers.select("node", "ids", "sims", F.lit(False).alias("old"))
    if graph is not None:
        rows = rows.union(graph.select("node", "ids", "sims", F.lit(True)))
    dealt = rows.repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(run, "node bigint, ids array<bigint>, sims array<float>, fresh array<boolean>")


def _start(codes: DataFrame, count: int, tables: int, block: int, degree: int) -> DataFrame:
    """First neighbours from blocks of nodes on the same side of random planes."""
    bits = max(0, int(np.ceil(np.log2(max(1, count) / (block / 2)))))

    def sides(batches):
        for batch in batches:
            if not len(batch):
                continue
            vectors = _codes_of(batch.column("code"))
            keys = []
            for t in range(tables):
                planes = np.random.default_rng(100 + t).normal(size=(vectors.shape[1], max(bits, 1)))
                side = (vectors @ planes > 0)[:, :bits].astype(np.int64)
                keys.append((side << np.arange(bits)).sum(axis=1) * tables + t)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _lists(list(np.stack(keys, axis=1)), pa.int64())], ["node", "code", "keys"]
            )

    keyed = codes.mapInArrow(sides, "node bigint, code binary, keys array<bigint>")
    keyed = staged(keyed.select("node", "code", F.explode("keys").alias("key")))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    placed = keyed.join(sizes, "key")
    center = F.xxhash64("key", F.pmod(F.xxhash64("node", "key"), F.col("parts")))
    groups = placed.select(
        center.alias("center"), F.col("node").alias("member"), "code", F.lit(True).alias("fresh"),
        F.lit(float("-inf")).cast("float").alias("least"),
    )
    return staged(_merged(None, _local_join(groups, degree), degree))


def descend(codes: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS, tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """``node, ids, sims, fresh``: the neighbour graph of all nodes with a neighbour."""
    count = codes.count()
    graph = _start(codes, count, tables, block, degree)
    for _ in range(rounds):
        edges = graph.select("node", F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select(
            "node", F.col("e.ids").alias("near"), F.col("e.fresh").alias("fresh")
        )
        # A node that many have as neighbour brings them together in several groups, each with its own neighbours.
        arriving = edges.groupBy("near").agg(F.ceil(F.count("*") / (2 * degree)).cast("int").alias("parts"))
        backward = edges.join(arriving, "near").select(
            F.xxhash64("near", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("center"),
            F.col("node").alias("member"), "fresh",
        )
        last = F.coalesce("parts", F.lit(1)) - 1
        forward = edges.join(arriving.withColumnRenamed("near", "node"), "node", "left").select(
            "node", "near", "fresh", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("part")
        )
        forward = forward.select(F.xxhash64("node", "part").alias("center"), F.col("near").alias("member"), "fresh")
        full = F.size("ids") >= degree
        least = graph.select(
            F.col("node").alias("member"), F.when(full, F.array_min("sims")).otherwise(float("-inf")).cast("float").alias("least")
        )
        known = codes.select(F.col("node").alias("member"), "code").join(least, "member", "left")
        known = known.withColumn("least", F.coalesce("least", F.lit(float("-inf")).cast("float")))
        members = backward.union(forward).join(known, "member")
        graph = staged(_merged(graph, _local_join(members, OFFERS), degree))
        changed = graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0] or 0
        if changed <= ENOUGH * count * degree:
            break
    return graph


def build(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", copies: int = 21, degree: int = DEGREE) -> Index:
    """An index of every usable vector.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those without
    an id or of another length than the most frequent one (the longer of equally frequent ones). Of equal
    vectors the ``copies`` least ids are kept: as many as any answer can hold.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("raw")).filter("id IS NOT NULL")
    lengths = rows.groupBy(F.size("raw").alias("n")).count().orderBy(F.desc("count"), F.desc("n"))
    most = lengths.filter("n > 0").first()
    length = most.n if most else 1
    usable_rows = rows.filter(usable(F.col("raw"), length)).select("id", _as_doubles(F.col("raw")).alias("vector"))
    usable_rows = usable_rows.withColumn("node", F.xxhash64("vector"))
    ranked = usable_rows.withColumn(
        "at", F.row_number().over(Window.partitionBy("node", "vector").orderBy("id"))
    ).filter(F.col("at") <= copies)
    nodes = staged(ranked.groupBy("node", "vector").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    longest = nodes.agg(F.max(F.sqrt(squares))).first()[0] or 1.0
    codes = staged(_coded(nodes, longest))
    graph = descend(codes, degree)
    links = graph.select("node", F.explode("ids").alias("near"))
    links = staged(links.union(links.select("near", "node")).distinct())
    return Index(nodes, codes, links, longest, copies)


_STATE = "q bigint, code binary, ids array<bigint>, sims array<float>, done array<boolean>, next array<bigint>"


def _expanded(state: DataFrame, found: DataFrame, size: int, beam: int) -> DataFrame:
    """States with the found nodes (``q, near, code``) taken in, and the nodes to expand next."""

    def run(batches):
        for batch in _runs(batches, "q"):
            keys = batch.column("q").to_numpy()
            near_all = batch.column("near")
            out: list[list] = [[] for _ in range(6)]
            edges = _edges_of(keys)
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                own = int(np.flatnonzero(near_all.slice(a, z - a).is_null().to_numpy(zero_copy_only=False))[0]) + a
                code = batch.column("code")[own].as_py()
                ids = np.array(batch.column("ids")[own].as_py(), np.int64)
                sims = np.array(batch.column("sims")[own].as_py(), np.float32)
                done = np.array(batch.column("done")[own].as_py(), bool)
                rest = [i for i in range(a, z) if i != own]
                if rest:
                    near = near_all.take(pa.array(rest)).to_numpy(zero_copy_only=False).astype(np.int64)
                    new = ~np.isin(near, ids)
                    if new.any():
                        codes = _codes_of(batch.column("code").take(pa.array(rest)))[new]
                        ids = np.concatenate([ids, near[new]])
                        sims = np.concatenate([sims, codes @ np.frombuffer(code, np.float16).astype(np.float32)])
                        done = np.concatenate([done, np.zeros(int(new.sum()), bool)])
                best = np.lexsort((ids, -sims))[:size]
                ids, sims, done = ids[best], sims[best], done[best].copy()
                following = np.flatnonzero(~done)[:beam]
                done[following] = True
                for column, value in zip(out, (keys[a], code, ids, sims, done, ids[following]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(out[0], np.int64)), pa.array(out[1], pa.binary()), _lists(out[2], pa.int64()),
                 _lists(out[3], pa.float32()), _lists(out[4], pa.bool_()), _lists(out[5], pa.int64())],
                ["q", "code", "ids", "sims", "done", "next"],
            )

    none = F.lit(None)
    held = state.select("q", "code", "ids", "sims", "done", none.cast("bigint").alias("near"))
    more = found.select(
        "q", "code", none.cast("array<bigint>").alias("ids"), none.cast("array<float>").alias("sims"),
        none.cast("array<boolean>").alias("done"), "near",
    )
    dealt = held.union(more).repartition("q").sortWithinPartitions("q")
    return dealt.mapInArrow(run, _STATE)


def search(
    index: Index, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = 20,
    size: int = LIST, beam: int = BEAM,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found to each usable query, a row with the query's id left out.

    Scores are inner products in double precision on the original vectors; ties go to the lower id.
    Queries with equal vectors are searched once. Queries that are not usable have no answer. ``top`` must be
    below the index's ``copies``: of more equal vectors than that, answers would lack some.
    """
    if top >= index.copies:
        raise ValueError(f"the index keeps {index.copies} copies of a vector: top must be below, or copies higher")
    first = index.nodes.select(F.size("vector").alias("n")).first()
    length = first.n if first else 1
    asked = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("raw")).filter("query_id IS NOT NULL")
    asked = asked.filter(usable(F.col("raw"), length)).select("query_id", _as_doubles(F.col("raw")).alias("vector"))
    asked = staged(asked.withColumn("node", F.xxhash64("vector")))
    distinct = asked.groupBy("node").agg(F.first("vector").alias("vector"))
    coded = staged(_coded(distinct, index.longest, asked=True).withColumnRenamed("node", "q"))
    empty = [F.array().cast(k).alias(n) for n, k in (("ids", "array<bigint>"), ("sims", "array<float>"), ("done", "array<boolean>"))]
    state = coded.select("q", "code", *empty)
    entries = [row.node for row in index.codes.select("node").orderBy(F.xxhash64("node")).limit(ENTRIES).collect()]
    starts = F.array(F.col("q"), *[F.lit(e) for e in entries])
    wanted = coded.select("q", F.explode(F.array_distinct(starts)).alias("near"))
    codes = index.codes.withColumnRenamed("node", "near")
    for _ in range(SEARCH_ROUNDS):
        state = staged(_expanded(state, wanted.join(codes, "near").select("q", "near", "code"), size, beam))
        ahead = state.select("q", F.explode("next").alias("node"))
        if ahead.isEmpty():
            break
        wanted = ahead.join(index.links, "node").select("q", "near").distinct()
    pairs = state.select("q", F.explode("ids").alias("node"))
    one = distinct.select(F.col("node").alias("q"), F.col("vector").alias("mine"))
    product = F.aggregate(
        F.zip_with("mine", "vector", lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x
    )
    scored = pairs.join(index.nodes, "node").join(one, "q").select("q", product.alias("score"), "ids")
    answers = scored.join(asked.select("query_id", F.col("node").alias("q")), "q")
    answers = answers.select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
