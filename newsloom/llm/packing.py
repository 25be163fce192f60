"""Packing documents into token windows: bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document goes whole into the fullest window
that still holds it. If none does, the fullest window is emitted: its gap is filled with the head
of the document when the gap is worth a cut. What is left open at the end of a partition (at most
``open_windows`` windows, whatever the size of the partition) is merged in rounds, ``fan`` partitions at
a time, by the same rule, until one group is left.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.texts import blocks, is_space, lower_ascii, runs, span_hashes, worker_value
from newsloom.plans.staging import staged

WINDOW = 2048
OPEN_WINDOWS = 16
LEAST_CUT = 32
FAN = 16
END_ID = 1
CACHED_WORDS = 800_000

_PIECE = "doc_id {key}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
_SEPARATOR = "\x01"


class Piece(NamedTuple):
    """A run of one document's ids, held as little-endian 32-bit bytes."""

    doc_id: object
    start: int
    doc_tokens: int
    ids: bytes

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[: 4 * at]), self._replace(start=self.start + at, ids=self.ids[4 * at :])


class Windows:
    """Open windows of one task, best fit, at most ``most`` of them."""

    def __init__(self, size: int, most: int, least_cut: int) -> None:
        self.size, self.most, self.least_cut = size, most, least_cut
        self.free: list[tuple[int, int]] = []  # (free room, window), ascending
        self.held: dict[int, list[Piece]] = {}
        self.made = 0

    def _open(self, pieces: list[Piece], used: int) -> None:
        self.held[self.made] = pieces
        insort(self.free, (self.size - used, self.made))
        self.made += 1

    def put(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        """Places pieces that belong together; yields windows that are emitted."""
        length = sum(p.length for p in pieces)
        while length:
            at = bisect_left(self.free, (min(length, self.size), -1))
            if at < len(self.free) and length <= self.size:
                room, window = self.free.pop(at)
                self.held[window] += pieces
                if room == length:
                    yield self.held.pop(window)
                else:
                    insort(self.free, (room - length, window))
                return
            if length >= self.size:
                head, pieces = split(pieces, self.size)
                yield head
                length -= self.size
            elif len(self.free) < self.most:
                self._open(pieces, length)
                return
            else:
                room, window = self.free.pop(0)
                emitted = self.held.pop(window)
                if room >= self.least_cut:
                    head, pieces = split(pieces, room)
                    emitted += head
                    length -= room
                yield emitted

    def rest(self) -> Iterator[list[Piece]]:
        for _, window in self.free:
            yield self.held[window]


def split(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The first ``at`` ids of the pieces and the others."""
    head: list[Piece] = []
    for n, piece in enumerate(pieces):
        if at >= piece.length:
            head.append(piece)
            at -= piece.length
        elif at:
            first, second = piece.cut(at)
            return [*head, first], [second, *pieces[n + 1 :]]
        else:
            return head, list(pieces[n:])
    return head, []


class _Words:
    """Ids of words by their hash, for a tokenizer that works on each white-space word alone.

    Words of letters are also split from the marks next to them. Words with an apostrophe, a special
    token's opening, control characters or other scripts are left to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        alone = self.tokenizer.encode(_SEPARATOR, add_special_tokens=False).ids
        self.separator = alone[0] if len(alone) == 1 else -1
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast([f" {_SEPARATOR} ".join(texts)], add_special_tokens=False)
        return np.array(found[0].ids, np.uint32)

    def _learn(self, hashes: np.ndarray, spans: list[bytes]) -> None:
        texts = [s.decode("utf-8") for s in spans]
        ids = self._ids(texts)
        cuts = np.flatnonzero(ids == self.separator)
        if len(cuts) != len(texts) - 1:  # a word holds the separator itself
            parts = [
                np.array(e.ids, np.uint32)
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ]
            counts = np.array([len(p) for p in parts], np.int64)
            ids = np.concatenate(parts)
            starts = np.cumsum(counts) - counts
        else:
            starts = np.concatenate([[0], cuts + 1])
            counts = np.concatenate([cuts, [len(ids)]]) - starts
        starts = starts + len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.known, hashes)
        self.first = np.insert(self.first, at, starts)
        self.count = np.insert(self.count, at, counts)
        self.known = np.insert(self.known, at, hashes)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and each text's offsets in them."""
        space = is_space(data)
        starts, ends = runs(~space, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        lower = lower_ascii(data)
        wide = data >= 0x80
        # Two-byte Latin letters with marks, but not the two signs among them.
        lead = data == 0xC3
        mark = np.zeros(len(data), bool)
        mark[1:] = lead[:-1] & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter = ((lower >= 97) & (lower <= 122)) | lead | (mark & wide)
        odd = (data == 0x27) | (data == 0x7F) | ((data < 32) & ~space) | (wide & ~letter)
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        odd[:-1] |= lead[:-1] & ~mark[1:]
        strange = np.add.reduceat(odd.astype(np.int32), starts) > 0
        strange_words = starts[strange], ends[strange]
        plain = ~space
        whole = np.zeros(len(data) + 1, np.int32)
        np.add.at(whole, strange_words[0], 1)
        np.add.at(whole, strange_words[1], -1)
        whole = np.cumsum(whole[:-1]) > 0
        change = np.flatnonzero((letter[1:] != letter[:-1]) & ~whole[1:] & ~whole[:-1]) + 1
        starts, ends = runs(plain, np.concatenate([offsets, change]))
        text = np.where(whole, data, lower)
        hashes = span_hashes(text, starts, ends) ^ whole[starts].astype(np.uint64)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > CACHED_WORDS:
            self.clear()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            raw = text.tobytes()
            firsts, lasts = starts[where[new]].tolist(), ends[where[new]].tolist()
            self._learn(distinct[new], [raw[a:z] for a, z in zip(firsts, lasts, strict=True)])
            at = np.searchsorted(self.known, distinct)
        counts = self.count[at][inverse]
        begin = np.cumsum(counts) - counts
        total = int(counts.sum())
        index = np.repeat(self.first[at][inverse] - begin, counts) + np.arange(total)
        edges = np.append(begin, total)[np.searchsorted(starts, offsets)]
        return self.ids[index], edges


def word_encoder(path: str) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Encoder of text buffers for a tokenizer file whose words do not depend on their neighbours."""
    return worker_value(f"words:{path}", lambda: _Words(path)).encode


def _records(windows: Iterator[tuple[int, list[Piece]]], key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Pieces of emitted windows with their place there."""
    columns: list[list] = [[] for _ in range(7)]

    def batch() -> pa.RecordBatch:
        types = [key, *[pa.int64()] * 6]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        for c in columns:
            c.clear()
        return pa.RecordBatch.from_arrays(arrays, names)

    for number, pieces in windows:
        offset = 0
        for p in pieces:
            row = (p.doc_id, p.start, p.length, zlib.crc32(p.ids), p.doc_tokens, number, offset)
            for c, value in zip(columns, row, strict=True):
                c.append(value)
            offset += p.length
        if len(columns[0]) >= 20_000:
            yield batch()
    yield batch()


def _left_batch(group: int, left: list[list[Piece]], key: pa.DataType) -> pa.RecordBatch:
    """The open windows of one task as a single row."""
    piece = pa.struct([("doc_id", key), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
    rows = [[p._asdict() for p in pieces] for pieces in left]
    return pa.RecordBatch.from_arrays(
        [pa.array([group], pa.int64()), pa.array([rows], pa.list_(pa.list_(piece)))], ["grp", "windows"]
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    key: str = "doc_id",
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    least_cut: int = LEAST_CUT,
    fan: int = FAN,
) -> DataFrame:
    """Every id of every document in exactly one piece of one window.

    ``tokenizer`` is a tokenizer file whose words do not depend on their neighbours. A document's
    ids end with ``END_ID``; a null text is empty and has that id alone. A document longer than a
    window is cut into full windows and a rest. Repeated and null ids are documents of their own;
    further columns are ignored; an empty table gives no rows.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    """
    kind = docs.select(key).schema[0].dataType
    key_sql = kind.simpleString()
    key_arrow = pa.int64() if key_sql == "bigint" else pa.int32() if key_sql == "int" else pa.string()
    if key_sql not in ("bigint", "int", "string"):
        raise TypeError(f"{key} must be bigint, int or string, not {key_sql}")
    fields = f"{_PIECE.format(key=key_sql)}, sequence_id bigint, offset bigint"
    piece_sql = f"struct<doc_id {key_sql}, start bigint, doc_tokens bigint, ids binary>"
    left_fields = f"grp bigint, windows array<array<{piece_sql}>>"

    def both(emitted: pa.RecordBatch | None, left: pa.RecordBatch | None) -> pa.RecordBatch:
        rows = len(emitted) if emitted is not None else len(left)
        columns = [
            *(emitted.columns if emitted is not None else [pa.nulls(rows, key_arrow)] + [pa.nulls(rows, pa.int64())] * 6),
            *(left.columns if left is not None else [pa.nulls(rows, pa.int64()), pa.nulls(rows, left_type)]),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "grp", "windows"]
    left_type = _left_batch(0, [], key_arrow).column(1).type

    def first_round(batches):
        task = TaskContext.get().partitionId()
        encode = word_encoder(tokenizer)
        open_now = Windows(window, open_windows, least_cut)
        base = task << 32
        count = [0]

        def numbered(batch):
            ids = batch.column(0).to_pylist()
            for first, data, offsets in blocks(batch.column(1)):
                tokens, edges = encode(data, offsets)
                for row in range(len(edges) - 1):
                    own = np.append(tokens[edges[row] : edges[row + 1]], np.uint32(END_ID)).astype("<u4")
                    piece = Piece(ids[first + row], 0, len(own), own.tobytes())
                    for full in open_now.put([piece]):
                        count[0] += 1
                        yield base + count[0], full

        for batch in batches:
            for out in _records(numbered(batch), key_arrow):
                if len(out):
                    yield both(out, None)
        left = list(open_now.rest())
        if left:
            yield both(None, _left_batch(task, left, key_arrow))

    def merge(level: int, last: bool):
        def run(keys, table):
            group = keys[0].as_py()
            open_now = Windows(window, open_windows, least_cut)
            base = (level << 58) + (group << 32)
            count = [0]
            parts = zip(table["grp"].to_pylist(), table["windows"].to_pylist(), strict=True)
            windows = [
                [Piece(**p) for p in pieces] for _, held in sorted(parts, key=lambda r: r[0]) for pieces in held
            ]
            windows.sort(key=lambda pieces: -sum(p.length for p in pieces))

            def numbered():
                for pieces in windows:
                    for full in open_now.put(pieces):
                        count[0] += 1
                        yield base + count[0], full
                if last:
                    # What is open at the very end is filled up by cuts, window by window.
                    ending = Windows(window, 1, least_cut)
                    for pieces in [*open_now.rest()]:
                        for full in ending.put(pieces):
                            count[0] += 1
                            yield base + count[0], full
                    for pieces in ending.rest():
                        count[0] += 1
                        yield base + count[0], pieces

            out = [both(records, None) for records in _records(numbered(), key_arrow)]
            if not last and open_now.held:
                out.append(both(None, _left_batch(group, list(open_now.rest()), key_arrow)))
            return pa.Table.from_batches(out)

        return run

    schema = f"{fields}, {left_fields}"
    placed = staged(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(first_round, schema))
    done = placed.filter("grp IS NULL").select(*names[:7])
    left = placed.filter("grp IS NOT NULL")
    groups = (left.agg(F.max("grp")).first()[0] or 0) + 1
    level = 1
    while True:
        groups = -(-groups // fan)
        merged = (
            left.select(F.floor(F.col("grp") / fan).alias("to"), "grp", "windows")
            .groupBy("to")
            .applyInArrow(merge(level, groups == 1), schema)
        )
        if groups == 1:
            return done.unionByName(merged.select(*names[:7]))
        merged = staged(merged)
        done = done.unionByName(merged.filter("grp IS NULL").select(*names[:7]))
        left = merged.filter("grp IS NOT NULL")
        level += 1
