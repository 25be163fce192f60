"""Exact Jaccard join of word shingle sets, with set relations used to skip work.

Documents with equal sets form one class. Shingles are ordered rare first, and a set posts only as
many as it must so that any partner shares one (the prefix). Posting lists are read in order of set
size and position: sizes that cannot match are skipped as blocks, and so are positions after which too
little is left to share. Shingles that no other set posts cannot be shared and count as lost.

Answers are derived from similar sets. Every class joins the family of the set with which it
shares most posted shingles. In a family, members are compared with a few pivots first; what links
with a common pivot, or with one another through pivots, needs no further comparison. Only the members
outside the family's main component are compared with the rest, block by block. Lists are then
used for pairs of different families and components alone, so groups of near copies are never
paired out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.components import components
from newsloom.llm.texts import SHINGLE_WORDS, blocks, mixed, shingles, word_hashes
from newsloom.plans.staging import staged

PERCENT = 75
SKETCH_BITS = 20
_SLICE_BITS = 12
BLOCK_SETS = 128
BLOCK_SHINGLES = 200_000
PIVOTS = 16


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingles of each text."""
    for _, data, offsets in blocks(texts):
        yield from shingles(*word_hashes(data, offsets), width)


def digest(found: np.ndarray) -> int:
    """Signed 64-bit digest of a set."""
    total = mixed(found).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(found))
    return int(mixed(total).view(np.int64)[0])


def least_overlap(size, percent: int):
    """Shingles that a set of this size shares with any partner, at least."""
    return -(-percent * size // 100)


def pair_overlap(one, two, percent: int):
    """Shingles that two sets of these sizes must share to be linked."""
    return -(-percent * (one + two) // (100 + percent))


def _sketch_and_sets(docs: DataFrame, width: int) -> DataFrame:
    """A row per document, and per task the counts of its shingles by hash bucket, in slices."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            classes, sizes = [], []
            for found in shingle_sets(batch.column("text"), width):
                sizes.append(len(found))
                classes.append(digest(found) if len(found) else None)
                at = (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                np.add.at(counts, at, np.uint32(1))
            rows = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                ["doc_id", "class", "n", "slice", "counts"],
            )
        slices = counts.reshape(-1, 1 << _SLICE_BITS)
        used = np.flatnonzero(slices.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(used), batch_key), pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.int64()),
             pa.array(used, pa.int32()), pa.array([slices[k].tobytes() for k in used], pa.binary())],
            ["doc_id", "class", "n", "slice", "counts"],
        )

    kind = dict(docs.dtypes)["doc_id"]
    batch_key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return docs.mapInArrow(run, f"doc_id {kind}, class bigint, n bigint, slice int, counts binary")


def _levels(partial: DataFrame) -> np.ndarray:
    """Order of magnitude of each hash bucket's count: a table of fixed size (2**SKETCH_BITS bytes)."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                counts = np.frombuffer(part, np.uint32).astype(np.int64)
                sums[k] = sums[k] + counts if k in sums else counts
        levels = [np.floor(np.log2(s + 1)).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["slice", "levels"]
        )

    summed = partial.repartition("slice").mapInArrow(run, "slice int, levels binary")
    out = np.zeros((1 << (SKETCH_BITS - _SLICE_BITS), 1 << _SLICE_BITS), np.uint8)
    for row in summed.collect():
        out[row["slice"]] = np.frombuffer(row.levels, np.uint8)
    return out.ravel()


def _postings(docs: DataFrame, levels: np.ndarray, width: int, percent: int) -> DataFrame:
    """``token, class, n, pos``: the prefix of every set, rare shingles first; once per task and class."""

    def run(batches):
        known: set[int] = set()
        for batch in batches:
            tokens, owners, sizes, lengths = [], [], [], []
            for found in shingle_sets(batch.column("text"), width):
                if not len(found) or (name := digest(found)) in known:
                    continue
                known.add(name)
                level = levels[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
                keys = (level << np.uint64(56)) | (found & np.uint64((1 << 56) - 1))
                prefix = len(found) - least_overlap(len(found), percent) + 1
                if prefix < len(keys):
                    keys = np.partition(keys, prefix - 1)[:prefix]
                keys.sort()
                tokens.append(keys)
                owners.append(name)
                sizes.append(len(found))
                lengths.append(prefix)
            if not tokens:
                continue
            for at in range(0, len(tokens), 256):
                part = slice(at, at + 256)
                each = np.array(lengths[part])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens[part]).view(np.int64)),
                        pa.array(np.repeat(np.array(owners[part], np.int64), each)),
                        pa.array(np.repeat(np.array(sizes[part], np.int32), each)),
                        pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in each])),
                    ],
                    ["token", "class", "n", "pos"],
                )

    return docs.select("text").mapInArrow(run, "token bigint, class bigint, n int, pos int")


def _shared_lists(postings: DataFrame) -> DataFrame:
    """Postings of lists with two classes or more, with the list's first class as leader."""

    def run(batches):
        token = leader = last = None  # of the list at hand, when it has two classes already
        leader_n = 0
        waiting = None  # the only row so far of the list at hand
        for batch in batches:
            rows = [batch.column(k).to_numpy() for k in range(4)]
            if waiting is not None:
                rows = [np.concatenate([w, r]) for w, r in zip(waiting, rows, strict=True)]
                waiting = None
            if not len(rows[0]):
                continue
            fresh = np.ones(len(rows[0]), bool)
            fresh[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            going = token is not None and rows[0][0] == token
            if going and rows[1][0] == last:
                fresh[0] = False
            ends = int(rows[0][-1]), int(rows[1][-1])
            rows = [r[fresh] for r in rows]
            if not len(rows[0]):
                continue
            first = np.ones(len(rows[0]), bool)
            first[1:] = rows[0][1:] != rows[0][:-1]
            run_of = np.cumsum(first) - 1
            starts = np.flatnonzero(first)
            sizes = np.diff(np.append(starts, len(first)))
            heads, head_n = rows[1][starts].copy(), rows[2][starts].copy()
            shared = sizes > 1
            if going and rows[0][0] == token:
                heads[0], head_n[0], shared[0] = leader, leader_n, True
            if shared[-1]:
                token, last = ends
                leader, leader_n = int(heads[-1]), int(head_n[-1])
            else:
                token = None
                waiting = [r[-1:] for r in rows]
            keep = shared[run_of]
            if keep.any():
                columns = [r[keep] for r in rows] + [heads[run_of][keep], head_n[run_of][keep]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], ["token", "class", "n", "pos", "leader", "leader_n"]
                )

    dealt = postings.repartition("token").sortWithinPartitions("token", "class")
    return dealt.mapInArrow(run, "token bigint, class bigint, n int, pos int, leader bigint, leader_n int")


def _possible(lists: DataFrame, percent: int) -> DataFrame:
    """Postings with ``before``, how many shared ones the class has ahead; hopeless ones are left out.

    Only shared shingles can be common with anyone: a class shares at most those ahead, this one, and all
    that follow. If that is less than it must share with its smallest partner, no link begins here.
    """
    ahead = Window.partitionBy("class").orderBy("pos")
    counted = lists.withColumn("before", F.row_number().over(ahead) - 1)
    needed = F.ceil(F.col("n") * percent / 100)
    return counted.filter(F.col("before") + F.col("n") - F.col("pos") >= needed)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common shingles of every two sets."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[code] > 1
    code = (np.cumsum(times > 1) - 1)[code[common]]
    owner = owner[common]
    out = np.zeros((len(sets), len(sets)), np.float32)
    step = 1 << 12
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        part = slice(*np.searchsorted(code, [at, at + step]))
        held = np.zeros((len(sets), step), np.float32)
        held[owner[part], code[part] - at] = 1
        out += held @ held.T
    return out.astype(np.int64)


def _linked_to(table: pa.Table, width: int, percent: int) -> pa.Table:
    """Links that connect what is connected among the texts of a group: one per class and component."""
    names: list[int] = []
    sets: list[np.ndarray] = []
    held: set[int] = set()
    for name, found in zip(table["class"].to_pylist(), shingle_sets(table["text"], width), strict=True):
        if name not in held:
            held.add(name)
            names.append(name)
            sets.append(found)
    a, b = [], []
    if len(sets) > 1:
        common = overlaps(sets)
        sizes = np.array([len(s) for s in sets])
        union = sizes[:, None] + sizes[None, :] - common
        linked = 100 * common >= percent * union
        np.fill_diagonal(linked, True)
        label = np.arange(len(sets))
        while True:
            near = np.where(linked, label[None, :], len(sets)).min(axis=1)
            near = near[near]
            if (near == label).all():
                break
            label = near
        a = [names[i] for i in np.flatnonzero(label != np.arange(len(sets)))]
        b = [names[label[i]] for i in np.flatnonzero(label != np.arange(len(sets)))]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _held_texts(docs: DataFrame, sharing: DataFrame, width: int) -> DataFrame:
    """``class, text``, one row for each of the ``sharing`` classes.

    The texts name their class themselves, so that rows without an id, or many rows of one id, are no more
    work than others; a task passes on a class once.
    """

    def run(batches):
        known: set[int] = set()
        for batch in batches:
            rows, names = [], []
            for row, found in enumerate(shingle_sets(batch.column("text"), width)):
                if len(found) and (name := digest(found)) not in known:
                    known.add(name)
                    rows.append(row)
                    names.append(name)
            for at in range(0, len(rows), 256):
                part = pa.array(rows[at : at + 256])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[at : at + 256], pa.int64()), batch.column("text").take(part)], ["class", "text"]
                )

    texts = docs.select("text").mapInArrow(run, "class bigint, text string").join(sharing, "class")
    return texts.groupBy("class").agg(F.any_value("text").alias("text"))


def _group_links(rows: DataFrame, held: DataFrame, group: list[str], width: int, percent: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        return _linked_to(table, width, percent)

    texts = rows.join(held, "class").select(*group, "class", "text")
    return texts.groupBy(*group).applyInArrow(run, "a bigint, b bigint")


def _cross_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of one list that differ in component and family and may still be linked.

    Rows of a list come by size and position. The k-th next row is looked at for all rows at once;
    a row drops out when the sizes ahead of it are too great.
    """

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, name, n, pos, ahead, family, label = rows
        first = np.ones(len(token), bool)
        first[1:] = token[1:] != token[:-1]
        run_of = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        mixed_runs = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
        mixed_runs &= np.minimum.reduceat(family, starts) != np.maximum.reduceat(family, starts)
        at = np.flatnonzero(mixed_runs[run_of])
        k = 1
        while len(at):
            at = at[at + k < len(token)]
            at = at[run_of[at + k] == run_of[at]]
            to = at + k
            fits = n[at] >= least_overlap(n[to], percent)
            at, to = at[fits], to[fits]
            before = np.minimum(ahead[at], ahead[to]) + 1
            after = np.minimum(n[at] - pos[at], n[to] - pos[to]) - 1
            good = before + after >= pair_overlap(n[at], n[to], percent)
            good &= (label[at] != label[to]) & (family[at] != family[to])
            good &= (family[at] != name[to]) & (family[to] != name[at])
            if good.any():
                x, y = name[at[good]], name[to[good]]
                swap = x > y
                nx, ny = n[at[good]], n[to[good]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(swap, y, x)), pa.array(np.where(swap, x, y)),
                     pa.array(np.where(swap, ny, nx)), pa.array(np.where(swap, nx, ny))],
                    ["a", "b", "na", "nb"],
                )
            k += 1

    def run(batches):
        kept: list[list[np.ndarray]] = []
        for batch in batches:
            rows = [batch.column(k).to_numpy() for k in range(7)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            if cut:  # everything before the last list of the batch is complete
                kept.append([r[:cut] for r in rows])
                yield from pairs([np.concatenate(c) for c in zip(*kept, strict=True)])
                kept = []
            kept.append([r[cut:] for r in rows])
        if kept:
            yield from pairs([np.concatenate(c) for c in zip(*kept, strict=True)])

    dealt = lists.select("token", "class", "n", "pos", "before", "family", "label")
    dealt = dealt.repartition("token").sortWithinPartitions("token", "n", "pos")
    found = dealt.mapInArrow(run, "a bigint, b bigint, na int, nb int")

    def rest(n: Column) -> Column:
        return F.ceil(n * percent / 100) - 1

    counted = found.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    needed = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    return counted.filter(F.col("c") + F.greatest(rest(F.col("na")), rest(F.col("nb"))) >= needed).select("a", "b")


def _verified(pairs: DataFrame, held: DataFrame, width: int, percent: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            a, b = [], []
            sides = zip(
                batch.column("a").to_pylist(), batch.column("b").to_pylist(),
                shingle_sets(batch.column("text_a"), width), shingle_sets(batch.column("text_b"), width),
                strict=True,
            )
            for x, y, one, two in sides:
                common = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * common >= percent * (len(one) + len(two) - common) and digest(one) == x and digest(two) == y:
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    one = held.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    two = held.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a bigint, b bigint")


def _families(lists: DataFrame) -> DataFrame:
    """``class, family, n``: each class with the leader it shares most lists with, and leaders with themselves.

    It is a grouping only, no link depends on it.
    """
    star = lists.filter("class != leader").groupBy("class", "leader").agg(
        F.count("*").alias("c"), F.min("n").alias("n"), F.min("leader_n").alias("leader_n")
    )
    best = (
        star.groupBy("class")
        .agg(F.max(F.struct("c", "leader", "leader_n", "n")).alias("best"))
        .select("class", "best.leader", "best.leader_n", "best.n")
    )
    best = staged(best)
    leaders = best.groupBy(F.col("leader").alias("class")).agg(F.min("leader_n").alias("n"))
    return best.select("class", F.col("leader").alias("family"), "n").union(
        leaders.select("class", F.col("class").alias("family"), "n")
    )


def jaccard_components(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    percent: int = PERCENT,
    width: int = SHINGLE_WORDS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_copies``, a row per document.

    Words are lower-cased (A-Z) runs of non-space characters. Two documents are linked when
    ``100 * intersection >= percent * union`` of their shingle sets; the component id is the least id
    reachable by links. A text with fewer words than the width has one shingle, its whole sequence;
    null and blank texts have none and are linked with nothing: they are their own component, also
    when their id repeats. ``n_copies`` counts the documents with the same set (1 for blank texts).
    Rows without an id are linked like others; a component of such rows alone has a null id.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    seen = staged(_sketch_and_sets(docs, width))
    levels = _levels(seen.filter("slice IS NOT NULL").select("slice", "counts"))
    rows = seen.filter("slice IS NULL").select("doc_id", "class", "n")
    classes = staged(
        rows.filter("class IS NOT NULL")
        .groupBy("class")
        .agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    )
    shared = staged(_shared_lists(_postings(docs, levels, width, percent)))
    lists = staged(_possible(shared, percent))

    held = staged(_held_texts(docs, lists.select("class").distinct(), width))
    members = _families(lists)
    sizes = members.groupBy("family").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    parts = F.ceil(F.greatest(F.col("m") / BLOCK_SETS, F.col("total") / BLOCK_SHINGLES)).cast("int")
    sizes = staged(sizes.select("family", parts.alias("parts")))
    members = members.join(sizes, "family")
    block = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    members = staged(members.select("class", "family", "parts", block.alias("block")))
    large = members.filter("parts > 1")
    first = Window.partitionBy("family").orderBy("class")
    pivots = large.withColumn("at", F.row_number().over(first)).filter(F.col("at") <= PIVOTS)
    everywhere = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    once = members.select("class", "family", "block").union(pivots.select("class", "family", everywhere))
    links = staged(_group_links(once, held, ["family", "block"], width, percent))
    known = components(links)

    # Members outside their family's main component against all members, block by block.
    named = large.join(known.withColumnRenamed("node", "class"), "class", "left")
    named = staged(named.withColumn("label", F.coalesce("label", "class")))
    main = named.groupBy("family", "label").agg(F.count("*").alias("m"))
    main = main.groupBy("family").agg(F.max(F.struct("m", "label")).alias("main")).select("family", "main.label")
    main = main.withColumnRenamed("label", "main")
    outside = staged(named.join(main, "family").filter("label != main").drop("main"))
    if not outside.isEmpty():
        counts = outside.groupBy("family").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("outer"))
        counts = staged(counts)
        outer = F.pmod(F.xxhash64("class", F.lit(1)), F.col("outer")).cast("int")
        one = outside.join(counts, "family").select(
            "class", "family", outer.alias("outer"), everywhere.alias("block")
        )
        two = large.join(counts, "family").select(
            "class", "family", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("outer"), "block"
        )
        links = links.union(staged(_group_links(one.union(two), held, ["family", "outer", "block"], width, percent)))

    family = members.groupBy("class").agg(F.min_by("family", F.col("family") == F.col("class")).alias("family"))
    related = lists.select("token", "class", "n", "pos", "before")
    related = related.join(family, "class", "left").join(known.withColumnRenamed("node", "class"), "class", "left")
    related = related.withColumns({"family": F.coalesce("family", "class"), "label": F.coalesce("label", "class")})
    pairs = staged(_cross_pairs(related, percent))
    if not pairs.isEmpty():
        links = links.union(staged(_verified(pairs, held, width, percent)))

    labels = components(links)
    named = classes.join(labels.withColumnRenamed("node", "class"), "class", "left")
    named = staged(named.withColumn("label", F.coalesce("label", "class")))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = staged(named.join(least, "label").select("class", "component_id", "copies"))
    linked = rows.filter("class IS NOT NULL").join(named, "class")
    alone = rows.filter("class IS NULL")
    n = F.col("n").alias("n_shingles")
    return linked.select("doc_id", n, "component_id", F.col("copies").alias("n_copies")).union(
        alone.select("doc_id", n, F.col("doc_id").alias("component_id"), F.lit(1).cast("bigint").alias("n_copies"))
    )
