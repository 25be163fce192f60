"""Document fingerprints by randomised edit embedding.

A cursor walks over a text's characters. At every step a shared random bit, given by the step and
the character under the cursor, says whether it moves on; texts that differ by few edits fall into step
again after each edit, so edit distance becomes Hamming distance between the walks. A fingerprint
samples the walk at shared steps: every ``2**level`` steps, the level such that a text has about
``SAMPLES`` to twice as many; each sample is a hash of the characters under the cursor there. The steps of
a level are among those of the level below, so texts of different length stay comparable.
Near copies are found by bands of samples, then verified on the texts.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.components import components
from newsloom.llm.texts import mixed, worker_value
from newsloom.plans.staging import staged

PERIOD = 1024
KINDS = 256
SAMPLES = 64
SPAN = 4
BAND = 4
BLOCK_CLASSES = 64


def _walk() -> list:
    """States of the walk: ``state[kind]`` is the state after a character, ``state[KINDS]`` its number.

    A state is the step modulo the period; the bits of the steps decide how long a character holds
    the cursor, on average two steps.
    """
    index = np.arange(PERIOD * KINDS, dtype=np.uint64)
    bits = (mixed(index * np.uint64(2) + np.uint64(1)) >> np.uint64(63)).reshape(PERIOD, KINDS).astype(bool)
    bits[PERIOD - 1] = True
    ahead = np.empty((PERIOD, KINDS), np.int64)
    ahead[PERIOD - 1] = PERIOD
    for step in range(PERIOD - 2, -1, -1):
        ahead[step] = np.where(bits[step], step + 1, ahead[step + 1])
    states: list[list] = [[] for _ in range(PERIOD)]
    for step, state in enumerate(states):
        state.extend([states[k] for k in (ahead[step] % PERIOD).tolist()])
        state.append(step)
    return states


def _kinds(text: str) -> tuple[bytes, np.ndarray]:
    """A kind from 0 to 255 for every code point, and the code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return ((points * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8).tobytes(), points


def _reached(place: np.ndarray) -> np.ndarray:
    """The step after each character, from the states' numbers before each and at the end."""
    return np.cumsum((np.diff(place) - 1) % PERIOD + 1)


def _samples(points: np.ndarray, reached: np.ndarray) -> str:
    """Fingerprint of a walk: ``level:hex``, a byte per sample; ``reached`` has the step after each character."""
    total = int(reached[-1]) if len(reached) else 0
    level = max(0, total.bit_length() - SAMPLES.bit_length())
    at = np.searchsorted(reached, np.arange(0, total, 1 << level), side="right")
    padded = np.concatenate([points, np.zeros(SPAN, np.uint32)]).astype(np.uint64)
    value = np.zeros(len(at), np.uint64)
    for k in range(SPAN):
        value = mixed(value + padded[at + k] + np.uint64(1))
    return f"{level}:{(value & np.uint64(255)).astype(np.uint8).tobytes().hex()}"


def fingerprint(text: str) -> str:
    """The fingerprint of a whole text; a short text is sampled at every step, an empty one nowhere."""
    kinds, points = _kinds(text)
    states = accumulate(kinds, getitem, initial=worker_value("walk", _walk)[0])
    return _samples(points, _reached(np.fromiter(map(itemgetter(KINDS), states), np.int64)))


def likeness(one: str, two: str) -> float:
    """Share of equal samples at common steps, 0 to 1; 1 for equal fingerprints."""
    if one == two:
        return 1.0
    (level_a, a), (level_b, b) = ((int(x.split(":")[0]), bytes.fromhex(x.split(":")[1])) for x in (one, two))
    if level_a < level_b:
        a = a[:: 1 << (level_b - level_a)]
    elif level_b < level_a:
        b = b[:: 1 << (level_a - level_b)]
    if not a or not b:
        return 0.0
    shorter = min(len(a), len(b))
    same = int((np.frombuffer(a[:shorter], np.uint8) == np.frombuffer(b[:shorter], np.uint8)).sum())
    return same / max(len(a), len(b))


def fingerprinted(text: Column) -> Column:
    """The fingerprint of every text; null counts as empty. Equal texts have equal fingerprints."""

    @F.arrow_udf("string")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py() or "") for t in texts], pa.string())

    return prints(text)


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt by id range; each range is lent the first row of the next one (the last: of the first).

    The bounds and the least id of each range, one per task, are all that comes to the driver; the
    texts are shuffled once. Columns ``doc_id, text, part, lent``.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    cuts = []
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        found = ids.agg(F.percentile_approx("doc_id", shares, 100 * parts).alias("cuts")).first().cuts
        cuts = sorted(set(found or []))
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    # Rows without id come first.
    part = F.coalesce(F.size(F.filter(bounds, lambda c: c < F.col("doc_id"))), F.lit(0))
    firsts = ids.groupBy(part.alias("part")).agg(
        F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("none")
    ).orderBy("part").collect()
    lender = {row.part: (None if row.none else row.first) for row in firsts}
    order = list(lender)
    own = F.struct(part.alias("part"), F.lit(False).alias("lent"))
    places = F.array(own)
    if order:
        before = {p: order[i - 1] for i, p in enumerate(order)}
        first_of = F.create_map(*[F.lit(x) for p in order for x in (p, lender[p])])
        lent_to = F.create_map(*[F.lit(x) for p in order for x in (p, before[p])])
        lends = F.col("doc_id").eqNullSafe(F.element_at(first_of, part).cast("bigint"))
        places = F.when(lends, F.array(own, F.struct(F.element_at(lent_to, part).alias("part"), F.lit(True).alias("lent")))).otherwise(places)
    placed = docs.withColumn("_to", F.explode(places)).select("doc_id", "text", "_to.part", "_to.lent")
    dealt = placed.repartitionById(max(parts, 1), F.col("part"))
    return dealt.sortWithinPartitions(F.col("lent"), F.col("doc_id").asc_nulls_first(), F.col("text"))


def edited_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited text, a row per document.

    Documents are ordered by their integer id (rows without one first; equal ids by text, null as
    empty). In the edited text the last quarter of the characters is replaced by as many from the
    beginning of the next document (or all of it); after the last comes the first. Returns ``doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def walked(text: str):
        kinds, points = _kinds(text)
        states = list(accumulate(kinds, getitem, initial=worker_value("walk", _walk)[0]))
        place = np.fromiter(map(itemgetter(KINDS), states), np.int64, len(states))
        return text, points, states, place, _samples(points, _reached(place))

    def finished(name, this, after):
        text, points, states, place, print_ = this
        changed = len(text) // 4
        kept = len(text) - changed
        edited = text[:kept] + after[0][:changed]
        if edited == text:
            edited_print = print_
        else:
            kinds, edited_points = _kinds(edited)
            tail = accumulate(kinds[kept:], getitem, initial=states[kept])
            place = np.append(place[:kept], np.fromiter(map(itemgetter(KINDS), tail), np.int64))
            edited_print = _samples(edited_points, _reached(place))
        return (
            name, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), print_,
            edited_print, likeness(print_, edited_print), likeness(print_, after[4]),
        )

    def run(batches):
        name = this = None
        lent_seen = False
        for batch in batches:
            out = []
            ids, lents = batch.column(0).to_pylist(), batch.column(3).to_pylist()
            for row in range(len(ids)):
                if lent_seen:
                    break
                one = walked(batch.column(1)[row].as_py())
                if this is not None:
                    out.append(finished(name, this, one))
                lent_seen = lents[row]
                name, this = ids[row], one
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
            )

    fields = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    return _with_next(docs).mapInArrow(run, fields)


def near_texts(docs: DataFrame, least: float = 0.75, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, group_id`` of every row: near texts by banding and verification.

    Equal texts (null as empty) are one class. Classes whose fingerprints agree on all of a band of
    samples, at a text's own level or the next, are linked if their edit distance is at most
    ``1 - least`` of the longer text. Groups are what such links connect; the group id is the least id
    in it. Empty texts are near empty ones only.

    Members of a band are compared with its least class first. What that connects needs no further
    comparison; all other pairs of a band, those of members not connected so far, are compared in blocks.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("class", F.sha2("text", 256))
    ids = staged(rows.select("doc_id", "class"))
    whole = rows.groupBy("class").agg(F.min("text").alias("text"))
    whole = staged(whole.withColumn("print", fingerprinted(F.col("text"))))

    @F.arrow_udf("array<string>")
    def bands(prints: pa.Array) -> pa.Array:
        out = []
        for one in prints.to_pylist():
            level, samples = int(one.split(":")[0]), bytes.fromhex(one.split(":")[1])
            found = []
            for up, part in ((level, samples), (level + 1, samples[::2])):
                found += [f"{up}:{k}:{part[k : k + BAND].hex()}" for k in range(0, len(part) - BAND + 1, BAND)]
            out.append(found or [one])
        return pa.array(out, pa.list_(pa.string()))

    keyed = staged(whole.select("class", F.explode(bands("print")).alias("band")))
    leaders = keyed.groupBy("band").agg(F.min("class").alias("leader"), F.max("class").alias("other"))
    leaders = leaders.filter("leader != other").select("band", "leader")
    pairs = keyed.join(leaders, "band").filter("class != leader")
    first = F.least("class", "leader").alias("a"), F.greatest("class", "leader").alias("b")

    def verified(pairs: DataFrame) -> DataFrame:
        one = whole.select(F.col("class").alias("a"), F.col("text").alias("one"))
        two = whole.select(F.col("class").alias("b"), F.col("text").alias("two"))
        longer = F.greatest(F.length("one"), F.length("two"))
        close = F.expr(f"levenshtein(one, two, cast(greatest(length(one), length(two)) * {1 - least} as int))")
        return pairs.join(one, "a").join(two, "b").filter((close >= 0) & (longer > 0)).select("a", "b")

    compared = staged(pairs.select(*first).distinct())
    linked = staged(verified(compared))
    labels = components(linked)
    grouped = keyed.join(labels.withColumnRenamed("node", "class"), "class", "left")
    grouped = staged(grouped.select("band", "class", F.coalesce("label", "class").alias("label")))
    # Bands with several groups: each group in blocks of classes, of which different groups' meet.
    several = grouped.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    several = several.filter("low != high").select("band")
    sizes = grouped.join(several, "band").groupBy("band", "label").agg(F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("class"), F.ceil(F.col("n") / BLOCK_CLASSES))
    blocks = grouped.join(sizes, ["band", "label"]).groupBy("band", "label", block.alias("block"))
    blocks = staged(blocks.agg(F.collect_list("class").alias("classes")))
    left, right = (blocks.select("band", *[F.col(c).alias(f"{c}_{k}") for c in blocks.columns[1:]]) for k in (1, 2))
    met = left.join(right, "band").filter("label_1 < label_2")
    met = met.repartition("band", "label_1", "block_1", "label_2", "block_2")
    rest = met.select(F.explode("classes_1").alias("class"), "classes_2")
    rest = rest.select("class", F.explode("classes_2").alias("leader")).select(*first).distinct()
    linked = linked.union(verified(rest.join(compared, ["a", "b"], "left_anti")))
    labels = components(linked)
    named = ids.join(labels.withColumnRenamed("node", "class"), "class", "left")
    named = staged(named.select("doc_id", F.coalesce("label", "class").alias("label")))
    least_id = named.groupBy("label").agg(F.min("doc_id").alias("group_id"))
    return named.join(least_id, "label").select("doc_id", "group_id")
