"""Balanced label propagation: linked documents gather in shards under capacity quotas.

Documents are linked by shared keys: equal texts, and equal least shingles (near copies). Documents
with equal texts form one node, in pieces of at most half a shard. In every round, joins bring each
node the weight of its keys' members per shard; nodes that would gain move, as far as quotas between
shards allow (greatest gains first, opposite moves against one another). At the end shards are
trimmed to counts that differ by one at most: unlinked documents move first, then small groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.texts import blocks, mixed, shingles, span_hashes, word_hashes
from newsloom.operators.positions import number_rows
from newsloom.plans.staging import staged

SHARDS = 8
ROUNDS = 6
SLACK = 0.05
_GAIN_LEVELS = 16


def _keys(docs: DataFrame) -> DataFrame:
    """``doc_id, size, crc, whole, least, second``: byte size, checksum and link keys of each text."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], []]
            for _, data, offsets in blocks(batch.column("text")):
                columns[0].append(span_hashes(data, offsets[:-1], offsets[1:]))
                sets = shingles(*word_hashes(data, offsets))
                zero = np.zeros(1, np.uint64)
                columns[1].append(np.concatenate([s[:1] if len(s) else zero for s in sets]))
                columns[2].append(np.array([mixed(s ^ np.uint64(0x5555)).min() if len(s) else 0 for s in sets], np.uint64))
            parts = [np.concatenate(c) if c else np.zeros(0, np.uint64) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("size"), batch.column("crc"),
                 *[pa.array(p.view(np.int64)) for p in parts]],
                ["doc_id", "size", "crc", "whole", "least", "second"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, size bigint, crc bigint, whole bigint, least bigint, second bigint")


def _per_shard(shards: int, weight: str) -> list[Column]:
    return [F.sum(F.when(F.col("shard") == s, F.col(weight)).otherwise(0)).alias(f"at{s}") for s in range(shards)]


def _quotas(wishes: list, load: dict[int, int], most: float) -> dict[tuple[int, int, int], float]:
    """Share of the weight of each (from, to, gain level) that may move.

    Between two shards as much moves one way as the other; beyond that, movers fill what room the
    target has left, greatest gains first.
    """
    wanted: dict[tuple[int, int], float] = {}
    for row in wishes:
        wanted[row.shard, row.best] = wanted.get((row.shard, row.best), 0) + row.weight
    allowed = {pair: min(w, wanted.get(pair[::-1], 0)) for pair, w in wanted.items()}
    room = {t: max(0.0, most - n) for t, n in load.items()}
    for pair in sorted(wanted):
        extra = min(wanted[pair] - allowed[pair], room.get(pair[1], 0.0))
        allowed[pair] += extra
        room[pair[1]] = room.get(pair[1], 0.0) - extra
    share = {}
    for row in sorted(wishes, key=lambda r: -r.level):
        pair = row.shard, row.best
        may = min(row.weight, allowed[pair])
        allowed[pair] -= may
        share[row.shard, row.best, row.level] = may / row.weight
    return share


def propagate(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """``node, weight, shard`` after label propagation under quotas.

    ``nodes`` has ``node, weight, shard`` (the start), ``links`` has ``node, key, weight``: nodes that share a key
    are linked. A shard may hold up to ``1 + slack`` times the mean weight, as far as moves decide. Only
    numbers per pair of shards and gain level come to the driver.
    """
    spark = nodes.sparkSession
    now = staged(nodes.select("node", "weight", "shard"))
    total = now.agg(F.sum("weight")).first()[0] or 0
    most = (1 + slack) * total / shards
    for number in range(rounds):
        held = links.join(now.select("node", "shard"), "node")
        tally = held.groupBy("key").agg(*_per_shard(shards, "weight"))
        seen = staged(held).join(tally, "key")
        # What the node itself brings to its own shard does not count.
        others = [
            (F.col(f"at{s}") - F.when(F.col("shard") == s, F.col("weight")).otherwise(0)).alias(f"at{s}")
            for s in range(shards)
        ]
        pull = seen.select("node", *others).groupBy("node").agg(*[F.sum(f"at{s}").alias(f"at{s}") for s in range(shards)])
        pull = now.join(pull, "node")
        most_pull = F.greatest(*[F.col(f"at{s}") for s in range(shards)])
        here = F.coalesce(*[F.when(F.col("shard") == s, F.col(f"at{s}")) for s in range(shards)])
        best = F.coalesce(*[F.when(F.col(f"at{s}") == most_pull, F.lit(s)) for s in range(shards)])
        gain = most_pull - here
        level = F.least(F.floor(F.log2(gain)), F.lit(_GAIN_LEVELS)).cast("int")
        # Half of the nodes a round, so that two linked nodes do not swap for ever.
        turn = F.pmod(F.xxhash64("node", F.lit(number)), F.lit(2)) == 0
        movers = staged(pull.filter((gain > 0) & turn).select("node", "weight", "shard", best.alias("best"), level.alias("level")))
        wishes = movers.groupBy("shard", "best", "level").agg(F.sum("weight").alias("weight")).collect()
        if not wishes:
            break
        load = {s: 0 for s in range(shards)} | {
            r["shard"]: r["weight"] for r in now.groupBy("shard").agg(F.sum("weight").alias("weight")).collect()
        }
        share = _quotas(wishes, load, most)
        # One row per pair of shards and gain level.
        quota = spark.createDataFrame([(*k, float(v)) for k, v in share.items()], "shard int, best int, level int, part double")
        chance = F.pmod(F.xxhash64("node", F.lit(number + 1000)), F.lit(1 << 20)) / float(1 << 20)
        moved = movers.join(F.broadcast(quota), ["shard", "best", "level"]).filter(chance < F.col("part"))
        moved = moved.select("node", F.col("best").alias("to"))
        now = staged(now.join(moved, "node", "left").select("node", "weight", F.coalesce("to", "shard").alias("shard")))
    return now


def _stepped(place: Column, starts: list[int], values: list[int]) -> Column:
    """The value of the last start that is not beyond the place."""
    out = F.lit(values[0])
    for start, value in zip(starts[1:], values[1:], strict=True):
        out = F.when(place >= start, F.lit(value)).otherwise(out)
    return out


def shard(docs: DataFrame, text: str = "text", key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row; counts per shard differ by one at most.

    ``size`` is the number of UTF-8 bytes of the text (null: none) plus one. Slots are gapless from 0 in
    each shard, by id. Equal texts stay together unless a shard cannot hold them; null counts as empty.
    Rows with equal or null ids are rows of their own.
    """
    filled = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        filled.alias("text"),
        (F.octet_length(filled) + 1).cast("bigint").alias("size"),
        F.crc32(filled.cast("binary")).alias("crc"),
    )
    rows = staged(_keys(rows))
    total = rows.count()
    most = max(1, total // (2 * shards))
    same = F.xxhash64("whole", "size", "crc")
    counts = rows.groupBy(same.alias("class")).agg(F.count("*").alias("copies"))
    # Classes larger than half a shard: at most 2 * shards of them, or a few more by rounding.
    large = counts.filter(F.col("copies") > most).select(
        F.col("class").alias("large"), F.ceil(F.col("copies") / most).cast("int").alias("pieces")
    )
    named = rows.withColumn("class", same).join(F.broadcast(large), F.col("class") == F.col("large"), "left")
    piece = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("pieces")), F.lit(0))
    # Pieces of a large class start two to a shard, all else where its least shingle says.
    start = F.when(
        F.col("pieces").isNotNull(), F.pmod(F.xxhash64("class") + F.floor(piece / 2), F.lit(shards))
    ).otherwise(F.pmod(F.xxhash64("least"), F.lit(shards)))
    named = named.withColumn("node", F.xxhash64("class", piece)).withColumn("start", start.cast("int"))
    rows = staged(named.select("doc_id", "size", "crc", "class", "least", "second", "node", "start"))

    groups = staged(rows.groupBy("node").agg(
        F.count("*").alias("weight"), F.min("start").alias("shard"),
        *[F.min(c).alias(c) for c in ("class", "least", "second")],
    ))
    keys = F.array(
        F.xxhash64(F.lit("text"), "class"), F.xxhash64(F.lit("least"), "least"), F.xxhash64(F.lit("second"), "second")
    )
    links = groups.select("node", "weight", F.explode(keys).alias("key"))
    shared = links.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    links = staged(links.join(shared, "key").select("node", "weight", "key"))
    placed = propagate(groups.select("node", "weight", "shard"), links, shards)

    linked = links.select("node").distinct().withColumn("linked", F.lit(1))
    ranks = placed.join(linked, "node", "left").select(
        "node", "shard", F.when(F.col("weight") > 1, 2).otherwise(F.coalesce("linked", F.lit(0))).alias("tie"), "weight"
    )
    full = staged(rows.join(ranks, "node").select("doc_id", "size", "crc", "node", "shard", "tie", "weight"))
    held = {r["shard"]: r["count"] for r in full.groupBy("shard").count().collect()}
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    over = [max(0, held.get(s, 0) - quota[s]) for s in range(shards)]
    under = [max(0, quota[s] - held.get(s, 0)) for s in range(shards)]
    starts = list(np.cumsum([0, *[held.get(s, 0) for s in range(shards)]])[:-1])
    numbered = number_rows(
        full.withColumn("any", F.monotonically_increasing_id()), ["shard", "tie", "weight", "node", "any"]
    )
    rank = F.col("position") - 1 - _stepped(F.col("shard"), list(range(shards)), [int(x) for x in starts])
    before = [int(x) for x in np.cumsum([0, *over])[:-1]]
    leaving = rank < _stepped(F.col("shard"), list(range(shards)), over)
    place = _stepped(F.col("shard"), list(range(shards)), before) + rank
    takers = [s for s in range(shards) if under[s]] or [0]
    ends = np.cumsum([0, *[under[s] for s in takers]])[:-1]
    to = F.when(leaving, _stepped(place, [int(x) for x in ends], takers)).otherwise(F.col("shard")).cast("int")
    even = numbered.select("doc_id", "size", "crc", to.alias("shard"))
    firsts = [int(x) for x in np.cumsum([0, *quota])[:-1]]
    final = number_rows(even.withColumn("any", F.monotonically_increasing_id()), ["shard", "doc_id", "any"])
    slot = F.col("position") - 1 - _stepped(F.col("shard"), list(range(shards)), firsts)
    return final.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", slot.cast("bigint").alias("slot"))
