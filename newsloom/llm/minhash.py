"""Near-duplicate documents by MinHash: bands, signatures, full sets and star-shaped components.

One pass over the texts takes ``BANDS * ROWS`` minima of universal hash functions over each set of word
shingles. Documents with equal sets are one class. Classes that agree in all minima of a band share a
bucket, and every class is compared with the first class of its buckets: by signatures (one byte of each
minimum), then on the full sets. Links become components by alternating large-star and small-star steps.

What is left are buckets with members of several components. Buckets whose first classes belong together
form a family; members outside a family's largest component are compared with all its members of other
components, block by block in tasks, again by signatures and then on the full sets. So no pair of classes
that shares a bucket is left out, and no pairs within a group are written: a task passes on the members that
may link, and then one link per member and component.

Two sets at the least similarity of 0.8 share no band with a chance of 1e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.jaccard import overlaps
from newsloom.llm.texts import blocks, mixed, shingles, word_hashes
from newsloom.plans.staging import staged

WIDTH = 4
PERCENT = 80
BANDS = 40
ROWS = 5
SEED = 20

# A pair whose estimate is this many standard deviations below the least similarity is not read in full.
DEVIATIONS = 6
# Signatures and sets of one side that a task compares.
BLOCK_MARKS = 1024
BLOCK_SETS = 128
# Documents that travel to Python at once.
BATCH_ROWS = 1000
# Up to so many row numbers (a few MB) travel to the tables they pick rows from; more are shuffled.
FEW_NODES = 200_000


def hash_functions(seed: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add-shift functions of 32-bit keys: strongly universal in the upper 32 bits."""
    pick = np.random.default_rng(seed)
    numbers = pick.integers(0, 1 << 64, (2, count), dtype=np.uint64)
    return numbers[0], numbers[1]


def signatures(sets: list[np.ndarray], seed: int, count: int) -> np.ndarray:
    """Minima of all hash functions over each set; a row per set, none of them empty."""
    factors, shifts = hash_functions(seed, count)
    keys = np.concatenate(sets) & np.uint64(0xFFFFFFFF)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), count), np.uint32)
    for i in range(count):
        hashed = keys * factors[i]
        hashed += shifts[i]
        out[:, i] = np.minimum.reduceat(hashed, starts) >> np.uint64(32)
    return out


def bucket_keys(minima: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per set and band, of the band's number and its minima."""
    parts = minima.reshape(len(minima), bands, -1).astype(np.uint64)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k] + np.uint64(1))
    return keys.view(np.int64)


@contextmanager
def _small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Whole texts go to Python in smaller batches while a table is written."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, rows)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _lists(values: np.ndarray) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def _read_texts(docs: DataFrame, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    """Each document's set size, the name of its set, bucket keys and signature (null without words).

    Of equal sets in a batch one has keys.
    """
    count = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            for row, data, offsets in blocks(batch.column("text")):
                sets = shingles(*word_hashes(data, offsets), width)
                names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                fresh = []
                for i, name in enumerate(names):
                    if name is not None and name not in seen:
                        seen.add(name)
                        fresh.append(i)
                place = np.full(len(sets), -1)
                place[fresh] = np.arange(len(fresh))
                take = pa.array(place, mask=place < 0)
                keys, marks = pa.array([], pa.list_(pa.int64())), []
                if fresh:
                    minima = signatures([sets[i] for i in fresh], seed, count)
                    keys = _lists(bucket_keys(minima, bands))
                    marks = [line.tobytes() for line in minima.astype(np.uint8)]
                part = batch.slice(row, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(names, pa.binary()),
                        keys.take(take),
                        pa.array(marks, pa.binary()).take(take),
                    ],
                    ["row", "doc_id", "n", "set", "keys", "marks"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {kind}, n bigint, set binary, keys array<bigint>, marks binary"
    return docs.select("row", "doc_id", "text").mapInArrow(run, schema)


def _only(frame: DataFrame, key: str, nodes: DataFrame) -> DataFrame:
    """``nodes`` with the rows of ``frame`` they name by ``key``; few nodes travel to the rows."""
    few = nodes.limit(FEW_NODES + 1).count() <= FEW_NODES
    return frame.join(F.broadcast(nodes) if few else nodes, frame[key] == nodes["node"]).drop(key)


def _least_matches(percent: int, count: int) -> float:
    """Equal bytes of two signatures below which the sets are taken for less similar."""
    share = percent / 100
    least = share - DEVIATIONS * (share * (1 - share) / count) ** 0.5
    return count * (least + (1 - least) / 256)


def _mark_matrix(column: pa.ChunkedArray | pa.Array, count: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, count)


def _alike(pairs: DataFrame, sketches: DataFrame, percent: int, count: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose signatures do not speak against it."""
    least = _least_matches(percent, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            equal = _mark_matrix(batch.column("marks"), count) == _mark_matrix(batch.column("leader_marks"), count)
            good = np.flatnonzero(equal.sum(axis=1) >= least)
            yield batch.select(["leader", "node"]).take(pa.array(good))

    leading = sketches.select(
        F.col("node").alias("leader"), F.col("n").alias("leader_n"), F.col("marks").alias("leader_marks")
    )
    both = pairs.join(sketches, "node").join(leading, "leader")
    fits = F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * percent
    return both.filter(fits).select("leader", "node", "marks", "leader_marks").mapInArrow(
        run, "leader bigint, node bigint"
    )


def _sets(rows: pa.Table, width: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for chunk in rows.column("text").chunks:
        for _, data, offsets in blocks(chunk):
            out += shingles(*word_hashes(data, offsets), width)
    return out


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs that link by their full sets: a leader with a block of its pairs in each task."""

    def run(rows: pa.Table) -> pa.Table:
        leader = rows.column("leader")[0].as_py()
        nodes, sets = rows.column("node").to_pylist(), _sets(rows, width)
        mine = sets[nodes.index(leader)]
        linked = []
        for node, other in zip(nodes, sets, strict=True):
            common = len(np.intersect1d(mine, other, assume_unique=True))
            if node != leader and 100 * common >= percent * (len(mine) + len(other) - common):
                linked.append(node)
        return pa.table({"a": pa.array([leader] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    sizes = pairs.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("blocks"))
    sizes = staged(sizes)
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = pairs.join(sizes, "leader").select("leader", block.alias("block"), "node")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    leading = sizes.select("leader", every.alias("block"), F.col("leader").alias("node"))
    placed = staged(members.union(leading))
    return _only(texts, "row", placed).groupBy("leader", "block").applyInArrow(run, "a bigint, b bigint")


def _blocked(outside: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """Blocks of a family's outside against blocks of all its members, each row with its side."""
    counts = members.groupBy("family").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    outer = outside.groupBy("family").agg(F.ceil(F.count("*") / most).cast("int").alias("outers"))
    counts = staged(counts.join(outer, "family"))
    hashed = F.xxhash64("node")
    columns = ["family", "outer", "block", "is_outside", "node", "label"]
    one = outside.join(counts, "family").withColumns(
        {
            "outer": F.pmod(hashed, F.col("outers")).cast("int"),
            "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)),
            "is_outside": F.lit(True),
        }
    )
    two = members.join(counts, "family").withColumns(
        {
            "outer": F.explode(F.sequence(F.lit(0), F.col("outers") - 1)),
            "block": F.pmod(hashed, F.col("blocks")).cast("int"),
            "is_outside": F.lit(False),
        }
    )
    return staged(one.select(*columns).union(two.select(*columns)))


def _may_link(placed: DataFrame, sketches: DataFrame, percent: int, count: int) -> DataFrame:
    """``family, node, label, is_outside`` of those with a partner by size and signature."""
    least = _least_matches(percent, count)

    def run(rows: pa.Table) -> pa.Table:
        outside = rows.column("is_outside").to_numpy()
        marks = _mark_matrix(rows.column("marks"), count)
        label, n = rows.column("label").to_numpy(), rows.column("n").to_numpy()
        others = np.flatnonzero(~outside)
        found = np.zeros(len(rows), bool)
        for at in np.flatnonzero(outside):
            fits = (label[others] != label[at]) & (
                np.minimum(n[others], n[at]) * 100 >= np.maximum(n[others], n[at]) * percent
            )
            fitting = others[fits]
            near = fitting[(marks[fitting] == marks[at]).sum(axis=1) >= least]
            found[near] = True
            found[at] = len(near) > 0
        return rows.select(["family", "node", "label", "is_outside"]).filter(pa.array(found))

    rows = placed.join(sketches, "node").groupBy("family", "outer", "block")
    return rows.applyInArrow(run, "family bigint, node bigint, label bigint, is_outside boolean")


def _rest_links(placed: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of outside members: one for each other component among the members they link with."""

    def run(rows: pa.Table) -> pa.Table:
        outside, label = rows.column("is_outside").to_numpy(), rows.column("label").to_numpy()
        node, sets = rows.column("node").to_numpy(), _sets(rows, width)
        a, b = [], []
        if outside.any() and not outside.all():
            sizes = np.array([len(s) for s in sets])
            common = overlaps(sets)[outside][:, ~outside]
            union = sizes[outside][:, None] + sizes[~outside][None, :] - common
            linked = (100 * common >= percent * union) & (label[outside][:, None] != label[~outside][None, :])
            for at in np.flatnonzero(linked.any(axis=1)):
                to = np.flatnonzero(linked[at])
                _, first = np.unique(label[~outside][to], return_index=True)
                b += node[~outside][to[first]].tolist()
                a += [int(node[outside][at])] * len(first)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _only(texts, "row", placed).groupBy("family", "outer", "block").applyInArrow(run, "a bigint, b bigint")


def _bucket_links(
    members: DataFrame, sketches: DataFrame, texts: DataFrame, width: int, percent: int, count: int
) -> DataFrame:
    """Links that connect what is connected among the classes of every bucket (``bucket, node, leader``)."""
    sketches = staged(_only(sketches, "row", staged(members.select("node").distinct())))
    pairs = staged(members.filter("leader != node").select("leader", "node").distinct())
    pairs = staged(_alike(pairs, sketches, percent, count))
    links = staged(_confirmed(pairs, texts, width, percent))
    roots = star_components(links).withColumnRenamed("root", "label")

    # The family of a class is the leader it meets most often; buckets go with the family of their leader.
    met = members.groupBy("node", "leader").agg(F.count("*").alias("times"))
    family = met.groupBy("node").agg(F.max_by("leader", F.struct("times", -F.col("leader"))).alias("family"))
    family = family.withColumnRenamed("node", "leader")
    present = members.select("leader", "node").distinct().join(family, "leader").select("family", "node").distinct()
    present = present.join(roots, "node", "left").withColumn("label", F.coalesce("label", "node"))
    present = staged(present)
    main = present.groupBy("family", "label").agg(F.count("*").alias("many"))
    main = main.groupBy("family").agg(
        F.max_by("label", F.struct("many", "label")).alias("main"), F.count("*").alias("labels")
    )
    several = staged(present.join(main.filter("labels > 1"), "family"))
    outside, everyone = several.filter("label != main").drop("main", "labels"), several.drop("main", "labels")
    active = staged(_may_link(_blocked(outside, everyone, BLOCK_MARKS), sketches, percent, count))
    if active.isEmpty():
        return links
    outside = staged(active.filter("is_outside").drop("is_outside").distinct())
    everyone = staged(active.filter("NOT is_outside").drop("is_outside").distinct())
    return links.union(staged(_rest_links(_blocked(outside, everyone, BLOCK_SETS), texts, width, percent)))


def star_components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of the links ``a, b``; the root is the component's least node.

    Large-star hangs the greater neighbours of a node on its least neighbour, small-star the lesser ones
    and the node itself; the two alternate until the links no longer change.
    """
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = staged(edges.distinct())
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
    state = edges.agg(F.count("*").alias("count"), mark).first()
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
        large = staged(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").filter("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = staged(small.union(least).distinct())
        before, state = state, edges.agg(F.count("*").alias("count"), mark).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select("b", "b").distinct()
            )


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    *,
    width: int = WIDTH,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, n_copies``, a row per document.

    Words are lower-cased (A-Z) runs of non-space characters. Documents link when
    ``100 * intersection >= percent * union`` of their sets of distinct ``width``-word shingles; a text with
    fewer words has one shingle, all its words. ``component_id`` is the least id reachable by links.
    Null and blank texts have no shingle and link with nothing: each is kept, and its own component, also
    when its id repeats. Rows of one id are rows of their own; all that carry their component's id are kept.
    Rows without an id link like others and are not kept beside an id; in a component without any id
    one row is kept, and the component id is null. ``n_copies`` counts the documents of the same set (1 for
    an empty set). Other columns are ignored; an empty table gives no row.
    """
    docs = staged(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(text).alias("text")
        )
    )
    with _small_batches(docs.sparkSession):
        found = staged(_read_texts(docs, width, bands, rows, seed))
    filled = found.filter("set IS NOT NULL")
    classes = staged(
        filled.groupBy("set").agg(
            F.min(F.when(F.col("keys").isNotNull(), F.col("row"))).alias("node"),
            F.min("doc_id").alias("least_id"),
            F.count("*").alias("copies"),
        )
    )
    # Rows in the buckets that hold several sets; then one row of each set.
    code = F.xxhash64("set").alias("code")
    placed = filled.filter("keys IS NOT NULL").select(F.explode("keys").alias("bucket"), code, "row")
    several = placed.groupBy("bucket").agg(F.min("code").alias("low"), F.max("code").alias("high"))
    members = placed.join(several.filter("low != high"), "bucket").select("bucket", F.col("row").alias("node"))
    # An inner join: a semi join would be moved below the explode and send the keys.
    members = staged(members.join(classes.select("node"), "node"))
    if members.isEmpty():
        named = classes.withColumn("root", F.col("node"))
    else:
        leaders = members.groupBy("bucket").agg(F.min("node").alias("leader"))
        members = staged(members.join(leaders, "bucket"))
        sketches = filled.filter("keys IS NOT NULL").select("row", "n", "marks")
        links = _bucket_links(members, sketches, docs.select("row", "text"), width, percent, bands * rows)
        named = classes.join(star_components(links), "node", "left")
        named = named.withColumn("root", F.coalesce("root", "node"))
    named = staged(named)
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = staged(named.join(least, "root").select("set", "root", "component_id", "copies"))
    of = filled.select("row", "doc_id", "n", "set").join(named, "set")
    is_kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & (F.col("row") == F.col("root")))
    grouped = of.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", is_kept.alias("kept"), F.col("copies").alias("n_copies")
    )
    alone = found.filter("set IS NULL").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"),
        F.lit(1).cast("bigint").alias("n_copies"),
    )
    return grouped.union(alone)
