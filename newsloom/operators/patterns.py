"""Texts that contain keywords, for any number of keywords.

Keywords are dealt into blocks of a bounded size. A task holds one block while texts stream past it, looks up what may
be a keyword at every place of a text by the keyword's first bytes and length, and writes the matches themselves: what is
shuffled are keywords and texts, never candidate pairs. The plan has the same size for one keyword and for a million.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.plans.staging import staged

LONGEST_GRAM = 3
# Keywords of a block, in bytes with what the table of one takes beside its text.
BLOCK_BYTES = 1 << 25
KEYWORD_BYTES = 64
# Rows of texts that meet a copy of a block, until there are so many copies; then each meets more rows.
SPLIT_ROWS = 2048
SPLITS = 256
# Matches that are returned at once, and those of one text.
_MATCHES = 1 << 16
# First bytes of a keyword by which it is looked up.
_HEAD = 3


def letter_grams(text: Column) -> Column:
    """Distinct runs of one to three characters of a text."""

    def cut(letters: Column) -> Column:
        def runs(n: int) -> Column:
            last = F.size(letters) - n
            places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.lit([]).cast("array<int>"))
            return F.transform(places, lambda at: F.concat(*[F.get(letters, at + k) for k in range(n)]))

        return F.array_distinct(F.concat(*[runs(n) for n in range(1, LONGEST_GRAM + 1)]))

    # As an element of an array the text is cut into characters once, not once per run.
    return F.get(F.transform(F.array(F.split(text, "")), cut), F.lit(0))


def matched_patterns(
    texts: DataFrame,
    patterns: DataFrame,
    *,
    key: str,
    columns: Sequence[str],
    pattern: str = "keyword",
) -> DataFrame:
    """``key, keyword``: for each row the keywords that a text column contains, whatever the case, each once.

    Null and empty keywords match nothing, and neither do null texts. Keywords that differ in case only are
    all reported, as they are written. Rows with equal keys, null ones too, are rows of their own. Rows are dealt by a
    hash of key and texts, so a key that many rows have does not gather them. Every row goes once to each block of
    keywords, and each block at most ``SPLITS`` times to the rows.
    """
    wanted = patterns.select(F.col(pattern).cast("string").alias("keyword")).filter(F.length("keyword") > 0)
    fields = F.array_compact(F.array(*[F.lower(F.col(c).cast("string")) for c in columns]))
    rows = texts.select(F.col(key).alias("key"), fields.alias("texts"))
    wanted = staged(wanted.distinct())
    size = wanted.agg(F.sum(F.octet_length("keyword") + KEYWORD_BYTES)).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    splits = min(rows.count() // SPLIT_ROWS + 1, SPLITS)
    block = F.pmod(F.xxhash64("keyword"), F.lit(blocks))
    copies = F.explode(F.sequence(block * splits, block * splits + (splits - 1)))
    held = wanted.select(copies.alias("slot"), "keyword", F.lower("keyword").alias("lowered"))
    split = F.pmod(F.xxhash64("key", "texts"), F.lit(splits))
    visits = F.explode(F.sequence(split, split + splits * (blocks - 1), F.lit(splits).cast("bigint")))
    dealt = held.unionByName(rows.select(visits.alias("slot"), "key", "texts"), allowMissingColumns=True)
    # Each slot is a task of its own; its keywords come before its texts.
    dealt = dealt.withColumn("slot", F.col("slot").cast("int")).repartitionById(blocks * splits, "slot")
    dealt = dealt.sortWithinPartitions(F.col("keyword").isNull())
    kind = rows.schema["key"].dataType.simpleString()
    return dealt.mapInArrow(_searched, f"key {kind}, keyword string").withColumnRenamed("key", key)


class _Block:
    """Keywords by their lower-case bytes, and the lengths of those that begin with the same bytes."""

    def __init__(self) -> None:
        self.written: list[pa.Array] = []
        self.count = 0
        self.numbers: dict[bytes, list[int]] = defaultdict(list)
        self.lengths: dict[bytes, set[int]] = defaultdict(set)

    def add(self, written: pa.Array, lowered: pa.Array) -> None:
        for number, word in enumerate(lowered.cast(pa.binary()).to_pylist(), self.count):
            self.numbers[word].append(number)
            self.lengths[word[:_HEAD]].add(len(word))
        self.written.append(written)
        self.count += len(written)

    def held_by(self, fields: Sequence[bytes]) -> list[int]:
        """Numbers of the keywords that a field contains, each once."""
        found: set[bytes] = set()
        for field in fields:
            for n in range(1, _HEAD):
                found.update(head for i in range(len(field)) if (head := field[i : i + n]) in self.numbers)
            for i in range(len(field) - _HEAD + 1):
                for length in self.lengths.get(field[i : i + _HEAD], ()):
                    if (word := field[i : i + length]) in self.numbers:
                        found.add(word)
        return [number for word in found for number in self.numbers[word]]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, keyword`` of the texts of a slot, from its keywords and then its texts.

    Texts are compared as bytes, as Spark does it; equal texts of a batch are searched once.
    """
    block, keywords = _Block(), None
    for batch in batches:
        many = batch.num_rows - batch.column("keyword").null_count
        if many:
            block.add(batch.column("keyword").slice(0, many), batch.column("lowered").slice(0, many))
        if many == batch.num_rows or not block.count:
            continue
        if keywords is None:
            keywords = pa.concat_arrays(block.written)
        keys, found = batch.column("key").slice(many), {}
        lists = batch.column("texts").slice(many).cast(pa.list_(pa.binary())).to_pylist()
        at, numbers = [], []
        for row, fields in enumerate(lists):
            same = tuple(fields)
            if same not in found:
                found[same] = block.held_by(same)
            at.extend([row] * len(found[same]))
            numbers.extend(found[same])
            if len(at) >= _MATCHES:
                yield _pairs(keys, keywords, at, numbers)
                at, numbers = [], []
        if at:
            yield _pairs(keys, keywords, at, numbers)


def _pairs(keys: pa.Array, keywords: pa.Array, at: list[int], numbers: list[int]) -> pa.RecordBatch:
    columns = [keys.take(pa.array(at, pa.int64())), keywords.take(pa.array(numbers, pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["key", "keyword"])
