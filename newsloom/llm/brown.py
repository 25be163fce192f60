"""Class-based bigram model: exchange clustering of words, class transitions, word emissions.

Words are counted over the whole training corpus, by 64-bit hash, and clustered in two steps.

1. The classes are laid out: the most frequent ``WORDS`` words are items, all others belong to the item of
   their ending (one of ``ENDINGS``). Bigrams of items fill a matrix of fixed size, on which exchange
   clustering moves one item after the other to the class that gains most mutual information.
2. Every other word that occurs ``LEAST_COUNT`` times or more is exchanged on its own, however many there
   are: its counts of classes before and after it, over the whole corpus, are summed by word, and the word
   moves to the class where they are likeliest, its own counts taken out of its old class. All words move at
   once against the same class table, in ``ROUNDS`` rounds. Rarer and unseen words keep the class of their
   ending.

Words are hashed to be counted; then every training text is written once more as a line of word numbers, and
bigrams, contexts and class tables are counted from these lines. Counts travel between tasks in packed rows:
those of the frequent words by ranges of their numbers, those of all other words by ranges of their hashes.
Until the last round nothing reads the classes of words beyond the frequent ones, so these are exchanged in it.

A token's probability is that of its class after the previous token's class, times its emission: its
count plus a half in the counts of its class. Counts and classes of the most frequent words (``FREQUENT``
rows, a bounded table) travel to the tasks; tokens beyond them are joined with the word table by a
shuffle, which no frequent word can skew, and come back to their text with their class. While classes are
learned, a neighbour beyond the frequent words counts under the class of its ending.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.texts import blocks, byte_sums, lower_ascii, mixed, ragged, span_hashes, text_buffers, words
from newsloom.plans.staging import staged

WORDS = 768
ENDINGS = 256  # a power of two
CLASSES = 48
KINDS = CLASSES + 1  # and the edge of a text
LEAST_COUNT = 3
ROUNDS = 2
FREQUENT = 1 << 18
HALF = 0.5
_SLICE_ROWS = 8
_SLICE_WORDS = 1 << 10  # frequent words whose contexts meet in one task
_SLICE_TOKENS = 1 << 20  # about as many tokens of other words do
_HELD = 1 << 20  # tokens a task holds before it sends their counts
_DECIDED = 1 << 14  # words that are exchanged at once
_BLOCK_BYTES = 1 << 18  # texts are hashed in the processor's cache
_PREFIX = 20
_CODE_BITS = 17  # of a word's class and its neighbours' in a text's rows, below its place


class Lexicon(NamedTuple):
    """The most frequent words by hash: count, class, and whether the word is an item of its own."""

    hashes: np.ndarray
    counts: np.ndarray
    kinds: np.ndarray
    items: np.ndarray

    def finder(self) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """A function from hashes to the place of each in the lexicon, and whether it is there.

        The first bits of a hash lead to the first word that has them; a few steps remain.
        """
        if not len(self.hashes):
            return lambda hashes: (np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool))
        shift, last = np.uint64(64 - _PREFIX), len(self.hashes) - 1
        held = np.append(self.hashes, np.uint64(2**64 - 1))
        firsts = np.searchsorted(self.hashes, np.arange(1 << _PREFIX, dtype=np.uint64) << shift).astype(np.int32)

        def places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = firsts[hashes >> shift]
            going = np.flatnonzero(held[at] < hashes)
            while len(going):
                at[going] += 1
                going = going[held[at[going]] < hashes[going]]
            at = np.minimum(at, last)
            return at, self.hashes[at] == hashes

        return places


class BrownModel(NamedTuple):
    """Class of each ending, log10 transitions between classes, log10 of each class's emission total."""

    endings: np.ndarray
    transitions: np.ndarray
    emission_totals: np.ndarray
    lexicon: Lexicon
    tokens: int
    types: int
    ends: int


def _hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending of every word, and each text's offsets in them.

    An ending is the last three bytes up to the last letter, and whether marks follow.
    """
    data = lower_ascii(data)
    starts, ends, bounds = words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), bounds
    # Few words end in marks: only these look back for their last letter, a few steps one by one.
    letter = np.zeros(256, bool)
    letter[97:123] = letter[128:] = True
    upto = ends.copy()
    going = np.flatnonzero(~letter[data[ends - 1]])
    marked = np.zeros(len(ends), np.uint64)
    for _ in range(64):
        upto[going] -= 1
        going = going[upto[going] > starts[going]]
        going = going[~letter[data[upto[going] - 1]]]
    if len(going):
        letters = np.append(-1, np.flatnonzero(letter.take(data)))
        last = letters[np.searchsorted(letters, ends[going]) - 1]
        upto[going] = np.maximum(last + 1, starts[going])
    none = upto == starts
    marked[(upto < ends) & ~none] = 1
    upto[none] = ends[none]
    total = byte_sums(data)
    tails = span_hashes(data, np.maximum(starts, upto - 3), upto, total) ^ marked
    return span_hashes(data, starts, ends, total), (tails & np.uint64(ENDINGS - 1)).astype(np.int64), bounds


def _heads(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)


def _word_counts(training: DataFrame) -> DataFrame:
    """``h, ending, c`` of every distinct training word."""

    def counted(hashes, endings):
        hashes = np.concatenate(hashes)
        order = np.argsort(hashes)
        hashes = hashes[order]
        heads = _heads(hashes)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(hashes[heads].view(np.int64)),
                pa.array(np.concatenate(endings)[order[heads]].astype(np.int32)),
                pa.array(np.diff(np.append(heads, len(hashes)))),
            ],
            ["h", "ending", "c"],
        )

    def run(batches):
        held, size = ([], []), 0
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0), _BLOCK_BYTES):
                hashes, endings, _ = _hashed_words(data, offsets)
                held[0].append(hashes)
                held[1].append(endings.astype(np.uint8))
                size += len(hashes)
                if size >= _HELD:
                    yield counted(*held)
                    held, size = ([], []), 0
        if size:
            yield counted(*held)

    found = training.select("text").mapInArrow(run, "h bigint, ending int, c bigint")
    return found.groupBy("h").agg(F.min("ending").alias("ending"), F.sum("c").alias("c"))


def _lines(training: DataFrame, lexicon: Lexicon, numbers: np.ndarray) -> DataFrame:
    """``codes, seldom`` of every text: its words as 32-bit numbers, and the hashes of those without one.

    ``numbers`` are the numbers of the lexicon's words; any other word has ``FREQUENT`` plus its ending.
    """

    def run(batches):
        places = lexicon.finder()
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0), _BLOCK_BYTES):
                hashes, endings, bounds = _hashed_words(data, offsets)
                at, often = places(hashes)
                codes = FREQUENT + endings
                codes[often] = numbers[at[often]]
                behind = np.append(0, np.cumsum(~often))[bounds]
                yield pa.RecordBatch.from_arrays(
                    [_packed(codes.astype(np.uint32), bounds), _packed(hashes[~often], behind)], ["codes", "seldom"]
                )

    return training.select("text").mapInArrow(run, "codes binary, seldom binary")


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The runs of ``values`` between ``bounds`` as binary values."""
    offsets = (bounds * values.itemsize).astype(np.int64)
    held = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)]
    )
    return held.cast(pa.binary())


def _read_lines(batches, table: np.ndarray, edge: int) -> Iterator[tuple]:
    """Per block of texts: number and mark of every word, the marks with ``edge`` before each text, the texts' hashes."""
    for batch in batches:
        for first, data, offsets in blocks(batch.column(0)):
            codes, bounds = data.view(np.uint32), offsets // 4
            seldom = batch.column(1).slice(first, len(bounds) - 1) if batch.num_columns > 1 else None
            marks = table[codes]
            yield codes, marks, np.insert(marks, bounds[:-1], edge), bounds, seldom


def _bigrams(lines: DataFrame, items: np.ndarray) -> np.ndarray:
    """Counts of item after item over the whole training corpus; the last item is the text's edge.

    ``items`` has the item of each word number.
    """
    size = WORDS + ENDINGS + 1

    def run(batches):
        counts = np.zeros(size * size, np.int64)
        for _, _, line, _, _ in _read_lines(batches, items, size - 1):
            counts += np.bincount(line * size + np.append(line[1:], size - 1), minlength=size * size)
        table = counts.reshape(size, size)
        for at in range(0, size, _SLICE_ROWS):
            yield pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([table[at : at + _SLICE_ROWS].astype(np.uint32).tobytes()], pa.binary())],
                ["slice", "counts"],
            )

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(part, np.uint32).astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
            ["slice", "counts"],
        )

    kind = "slice int, counts binary"
    out = np.zeros((size, size), np.int64)
    for row in lines.select("codes").mapInArrow(run, kind).repartition("slice").mapInArrow(add, kind).collect():
        part = np.frombuffer(row.counts, np.int64).reshape(-1, size)
        out[row["slice"] : row["slice"] + len(part)] += part
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, rounds: int = 12) -> np.ndarray:
    """Class of each item; the last item (a text's edge) keeps the last class to itself.

    Starts from the items by falling count, dealt round; an item moves to the class where the mutual
    information of neighbouring classes is greatest (ties: the lowest class), until none moves.
    """
    size = len(bigrams)
    counts = bigrams.sum(axis=1) + bigrams.sum(axis=0)
    order = np.argsort(-counts[:-1], kind="stable")
    order = order[counts[order] > 0]
    label = np.zeros(size, np.int64)
    label[order] = np.arange(len(order)) % classes
    label[-1] = classes
    member = np.zeros((size, classes + 1))
    member[np.arange(size), label] = 1
    after = bigrams @ member  # of each item: the classes that follow it
    before = bigrams.T @ member
    table = member.T @ after
    for _ in range(rounds):
        moved = 0
        for item in order:
            own, home = float(bigrams[item, item]), label[item]
            right, left = after[item].copy(), before[item].copy()
            right[home] -= own
            left[home] -= own
            table[home] -= right
            table[:, home] -= left
            table[home, home] -= own
            kinds = np.arange(classes)
            cells = table[:classes]
            gain = (_xlogx(cells + right) - _xlogx(cells)).sum(axis=1)
            gain += (_xlogx(table[:, :classes] + left[:, None]) - _xlogx(table[:, :classes])).sum(axis=0)
            diagonal = table[kinds, kinds]
            r, lf = right[:classes], left[:classes]
            gain += _xlogx(diagonal + r + lf + own) - _xlogx(diagonal + r) - _xlogx(diagonal + lf) + _xlogx(diagonal)
            rows, columns = table[:classes].sum(axis=1), table[:, :classes].sum(axis=0)
            gain -= _xlogx(rows + right.sum() + own) - _xlogx(rows)
            gain -= _xlogx(columns + left.sum() + own) - _xlogx(columns)
            best = int(np.argmax(gain))
            if gain[best] <= gain[home] + 1e-9:
                best = int(home)
            table[best] += right
            table[:, best] += left
            table[best, best] += own
            if best != home:
                moved += 1
                label[item] = best
                after[:, home] -= bigrams[:, item]
                after[:, best] += bigrams[:, item]
                before[:, home] -= bigrams[item]
                before[:, best] += bigrams[item]
        if not moved:
            break
    return label


def _class_table(lines: DataFrame, kinds: np.ndarray) -> np.ndarray:
    """Counts of class after class over the whole training corpus; ``kinds`` has the class of each word number."""

    def run(batches):
        counts = np.zeros(KINDS * KINDS, np.int64)
        for _, _, line, _, _ in _read_lines(batches, kinds, CLASSES):
            counts += np.bincount(line * KINDS + np.append(line[1:], CLASSES), minlength=KINDS * KINDS)
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], ["cell", "c"])

    table = np.zeros(KINDS * KINDS)
    summed = lines.select("codes").mapInArrow(run, "cell bigint, c bigint").groupBy("cell").agg(F.sum("c").alias("c"))
    for row in summed.collect():  # KINDS**2 rows at most
        table[row.cell] = row.c
    return table.reshape(KINDS, KINDS)


def _contexts(lines: DataFrame, kinds: np.ndarray, wanted: np.ndarray, parts: int) -> DataFrame:
    """``slice, words, counts``: which classes stand before and after the words that are exchanged, packed.

    ``wanted`` tells which word numbers are exchanged. A slice below 0 has ``_SLICE_WORDS`` of them: number and
    both classes in one value, and how often it came. Words without a number are dealt into ``parts`` slices by
    ranges of their hash: hash, and own class and both neighbours' of every token. With no parts they are left out.
    """
    width = _SLICE_WORDS * KINDS**2

    def sent(slices, upto, words, counts):
        """A row for each run of words that ends at ``upto`` and is not empty."""
        full = np.flatnonzero(np.diff(upto, prepend=0))
        bounds = np.append(0, upto[full])
        return pa.RecordBatch.from_arrays(
            [pa.array(slices[full].astype(np.int32)), _packed(words, bounds), _packed(counts, bounds)],
            ["slice", "words", "counts"],
        )

    def often(held):
        keys = np.concatenate(held)
        keys.sort()
        heads = _heads(keys)
        counts = np.diff(np.append(heads, len(keys))).astype(np.uint32)
        keys = keys[heads]
        slices = np.arange(-(-FREQUENT // _SLICE_WORDS))
        return sent(~slices, np.searchsorted(keys, ((slices + 1) * width).astype(np.uint32)), keys, counts)

    def rare(held):
        hashes, around = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(hashes)
        hashes = hashes[order]
        part = (hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        slices = np.arange(parts)
        upto = np.searchsorted(part, slices.astype(np.uint64), side="right")
        return sent(slices, upto, hashes, around[order])

    def run(batches):
        held: dict[Callable, list] = {often: [], rare: []}
        sizes = dict.fromkeys(held, 0)
        for codes, marks, line, bounds, seldom in _read_lines(batches, kinds, CLASSES):
            around = np.roll(line, 1) * KINDS + np.append(line[1:], CLASSES)
            around = np.delete(around, bounds[:-1] + np.arange(len(bounds) - 1)).astype(np.uint32)
            some = np.flatnonzero(wanted[codes])
            held[often].append(codes[some] * np.uint32(KINDS**2) + around[some])
            sizes[often] += len(some)
            if parts:
                others = np.flatnonzero(codes >= FREQUENT)
                own = marks[others].astype(np.uint32) * np.uint32(KINDS**2)
                held[rare].append((text_buffers(seldom)[0].view(np.uint64).copy(), own + around[others]))
                sizes[rare] += len(others)
            for pack, size in sizes.items():
                if size >= _HELD:
                    yield pack(held[pack])
                    held[pack], sizes[pack] = [], 0
        for pack, size in sizes.items():
            if size:
                yield pack(held[pack])

    columns = ["codes", "seldom"] if parts else ["codes"]
    return lines.select(*columns).mapInArrow(run, "slice int, words binary, counts binary")


def likeliest(before: np.ndarray, after: np.ndarray, home: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each word in which its neighbours' classes are likeliest.

    ``before`` and ``after`` count the classes next to each word, ``home`` is its class so far and ``table``
    has the counts of class after class. Half a count is added to every cell; a word's own counts are
    taken out of its old class. A word moves only where it gains; ties go to the lowest class.
    """
    n_after, n_before = after.sum(axis=1), before.sum(axis=1)
    logs = np.log(table + HALF)
    starts, ends = table.sum(axis=1), table.sum(axis=0)
    room = HALF * KINDS
    gain = after @ logs[:CLASSES].T + before @ logs[:, :CLASSES]
    gain -= np.outer(n_after, np.log(starts[:CLASSES] + room)) + np.outer(n_before, np.log(ends[:CLASSES] + room))
    at = np.arange(len(home))
    stay = (after * np.log(np.maximum(table[home] - after, 0) + HALF)).sum(axis=1)
    stay += (before * np.log(np.maximum(table[:, home].T - before, 0) + HALF)).sum(axis=1)
    stay -= n_after * np.log(np.maximum(starts[home] - n_after, 0) + room)
    stay -= n_before * np.log(np.maximum(ends[home] - n_before, 0) + room)
    gain[at, home] = stay
    best = gain.argmax(axis=1)
    return np.where(gain[at, best] > stay + 1e-9, best, home)


def _exchanged(contexts: DataFrame, table: np.ndarray, hashes: np.ndarray, kinds: np.ndarray, least: int) -> DataFrame:
    """``h, kind, number`` of every word that is exchanged, from its contexts; a word without a number has -1.

    Of words without a number, those that occur ``least`` times or more are exchanged. ``hashes`` and ``kinds``
    are those of the word numbers. The rows of a slice come one after the other: those of
    numbered words are added up as they come, those of other words, about ``_SLICE_TOKENS`` tokens, wait for the last.
    """

    def moved(found, before, after, home, number):
        kind = likeliest(before, after, home, table)
        return pa.RecordBatch.from_arrays(
            [pa.array(found.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(number.astype(np.int32))],
            ["h", "kind", "number"],
        )

    def numbered(at, rows):
        size = _SLICE_WORDS * KINDS
        before, after = np.zeros(size), np.zeros(size)
        for words, counts in rows:
            words = np.frombuffer(words, np.uint32).astype(np.int64) - at * _SLICE_WORDS * KINDS**2
            counts = np.frombuffer(counts, np.uint32)
            before += np.bincount(words // KINDS, counts, size)
            after += np.bincount(words // KINDS**2 * KINDS + words % KINDS, counts, size)
        before, after = before.reshape(-1, KINDS), after.reshape(-1, KINDS)
        some = np.flatnonzero(after.any(axis=1))
        number = at * _SLICE_WORDS + some
        yield moved(hashes[number], before[some], after[some], kinds[number], number)

    def others(rows):
        rows = list(rows)
        found = np.concatenate([np.frombuffer(words, np.uint64) for words, _ in rows])
        codes = np.concatenate([np.frombuffer(counts, np.uint32) for _, counts in rows]).astype(np.int64)
        order = np.argsort(found)
        found, codes = found[order], codes[order]
        heads = _heads(found)
        ends = np.append(heads[1:], len(found))
        kept = ends - heads >= least
        heads, ends = heads[kept], ends[kept]
        for at in range(0, len(heads), _DECIDED):
            first, upto = heads[at : at + _DECIDED], ends[at : at + _DECIDED]
            n = len(first)
            code = codes[ragged(first, upto - first)]
            owner = np.repeat(np.arange(n), upto - first) * KINDS
            after = np.bincount(owner + code % KINDS, minlength=n * KINDS).reshape(n, KINDS)
            before = np.bincount(owner + code // KINDS % KINDS, minlength=n * KINDS).reshape(n, KINDS)
            yield moved(found[first], before, after, codes[first] // KINDS**2, np.full(n, -1))

    def run(batches):
        rows = (
            row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
        )
        for at, group in groupby(rows, key=itemgetter(0)):
            packed = (row[1:] for row in group)
            yield from others(packed) if at >= 0 else numbered(~at, packed)

    dealt = contexts.repartition("slice").sortWithinPartitions("slice")
    return dealt.mapInArrow(run, "h bigint, kind int, number int")


def fit(
    training: DataFrame, text: str = "text", least: int = LEAST_COUNT, rounds: int = ROUNDS
) -> tuple[BrownModel, DataFrame]:
    """The model and the table of all words (``h, c, kind``), learned from every training text.

    A null text is empty: its end alone is counted. Without training texts every word is unknown.
    """
    training = training.select(F.col(text).alias("text"))
    spark = training.sparkSession
    counts = staged(_word_counts(training))
    ends = training.count()

    def values(table, name: str) -> np.ndarray:
        return table[name].to_numpy()

    # Words are numbered by falling count, then by hash as Spark orders it; the first are the items.
    found = counts.orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()
    hashes, numbers, endings = values(found, "h").view(np.uint64), values(found, "c"), values(found, "ending")
    own = np.arange(len(hashes)) < WORDS
    order = np.argsort(hashes)

    def of_numbers(often: np.ndarray, ending: np.ndarray) -> np.ndarray:
        """A table for all word numbers, those of endings included."""
        table = np.zeros(FREQUENT + ENDINGS, np.int64)
        table[: len(often)], table[FREQUENT:] = often, ending
        return table

    unclassed = Lexicon(hashes[order], numbers[order], np.zeros(len(order), np.int64), own[order])
    lines = staged(_lines(training, unclassed, order))
    items = of_numbers(np.where(own, np.arange(len(hashes)), WORDS + endings), WORDS + np.arange(ENDINGS))
    bigrams = _bigrams(lines, items)
    label = exchange(bigrams)
    ending_kinds = label[WORDS:-1]
    kinds = label[items[: len(hashes)]]
    item_rows = [(int(h), int(k)) for h, k in zip(values(found, "h")[:WORDS], label, strict=False)]
    moved = spark.createDataFrame(item_rows, "h bigint, kind int")  # WORDS rows at most
    of_ending = F.element_at(F.split(F.lit(",".join(map(str, ending_kinds))), ",").cast("array<int>"), F.col("ending") + 1)

    # Every word still has its item's class: the table comes from the items' bigrams.
    member = np.eye(KINDS)[label]
    table = member.T @ bigrams @ member
    wanted = of_numbers(~own & (numbers >= least), np.zeros(ENDINGS)).astype(bool)
    seldom = (counts.agg(F.sum("c")).first()[0] or 0) - int(numbers.sum())
    for left in reversed(range(rounds)):
        parts = 0 if left or not seldom else seldom // _SLICE_TOKENS + 1
        contexts = _contexts(lines, of_numbers(kinds, ending_kinds), wanted, parts)
        exchanged = _exchanged(contexts, table, hashes, kinds, least)
        if not left:
            exchanged = staged(exchanged)
            moved = moved.union(exchanged.select("h", "kind"))
        news = exchanged.filter("number >= 0").select("number", "kind").toArrow()  # FREQUENT rows at most
        kinds = kinds.copy()
        kinds[values(news, "number")] = values(news, "kind")
        table = _class_table(lines, of_numbers(kinds, ending_kinds))
    rows = staged(counts.join(moved, "h", "left").select("h", "c", F.coalesce("kind", of_ending).alias("kind")))
    lexicon = Lexicon(hashes[order], numbers[order], kinds[order], own[order])

    share = (table.sum(axis=0) + HALF) / (table.sum() + HALF * KINDS)
    transitions = np.log10((table + share) / (table.sum(axis=1, keepdims=True) + 1))
    mass, types = np.zeros(KINDS), np.zeros(KINDS, np.int64)
    for row in rows.groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        mass[row.kind], types[row.kind] = row.c, row.v
    emission_totals = np.log10(mass + HALF * (types + 1))
    tokens = int(mass.sum()) + ends
    model = BrownModel(ending_kinds, transitions, emission_totals, lexicon, tokens, int(types.sum()) + (ends > 0), ends)
    return model, rows


def scores(docs: DataFrame, model: BrownModel, words: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score, perplexity`` of every row.

    Tokens are the lower-cased words and one end. ``base_score`` is the unigram log10 probability with
    half a count added, ``score`` the class model's. A null text is empty. Rows with equal or null ids
    are scored one by one; ids of any type are carried along.

    A word beyond the frequent ones leaves its text as a row with its place and its neighbours' classes,
    meets the word table, and comes back: a text's rows are sorted by place, and steps between two such
    words are taken then.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    ending_kinds, transitions, totals, lexicon = model[:4]
    unknown = KINDS  # in a code: the neighbour is such a word itself
    names = ["row", "h", "spot", "head"]  # a text's own values are its head
    inside = ["doc_id", "n_tokens", "known", "logs", "rest"]

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        places = lexicon.finder()
        for batch in batches:
            ids = batch.column("doc_id")
            for first, data, offsets in blocks(batch.column("text"), _BLOCK_BYTES):
                hashes, endings, bounds = _hashed_words(data, offsets)
                rows = len(offsets) - 1
                own = np.repeat(np.arange(rows), np.diff(bounds))
                at, often = places(hashes)
                kinds = ending_kinds[endings]
                inner = np.where(often, lexicon.kinds[at], unknown) if len(lexicon.hashes) else np.full(len(hashes), unknown)
                line = np.insert(inner, bounds[:-1], CLASSES)
                after = np.append(line[1:], CLASSES)
                step = np.zeros(len(line))
                both = (line != unknown) & (after != unknown)
                step[both] = transitions[line[both], after[both]]
                rest = np.bincount(np.insert(own, bounds[:-1], np.arange(rows)), step, rows)
                rest -= np.bincount(own[often], totals[inner[often]], rows)
                logs = np.zeros(rows)
                if often.any():
                    logs = np.bincount(own[often], np.log10(lexicon.counts[at[often]] + HALF), rows)
                known = np.bincount(own[often], minlength=rows)
                number = base + np.arange(rows)
                base += rows
                head = pa.StructArray.from_arrays(
                    [
                        ids.slice(first, rows),
                        pa.array(np.diff(bounds) + 1),
                        pa.array(known),
                        pa.array(logs),
                        pa.array(rest),
                    ],
                    inside,
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number),
                        # A value of its own: no word's hash, so that no rows pile up under a null.
                        pa.array(mixed(~number.astype(np.uint64)).view(np.int64)),
                        pa.array(np.full(rows, -1)),
                        head,
                    ],
                    names,
                )
                seldom = np.flatnonzero(~often)
                if len(seldom):
                    # A word's place in the line is behind the edges of the texts up to its own.
                    spot = seldom + own[seldom] + 1
                    code = (kinds[seldom] * (KINDS + 1) + line[spot - 1]) * (KINDS + 1) + after[spot]
                    place = seldom - bounds[own[seldom]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(number[own[seldom]]),
                            pa.array(hashes[seldom].view(np.int64)),
                            pa.array((place << _CODE_BITS) + code),
                            pa.nulls(len(seldom), head.type),
                        ],
                        names,
                    )

    sums = ["known", "logs", "rest"]

    def back(batches):
        """Sums of each text's rows; a text begins with its own row and may go on in the next batch."""
        held, last = None, CLASSES
        for batch in batches:
            if not batch.num_rows:
                continue
            spot, c, own = (batch.column(n).fill_null(0).to_numpy(zero_copy_only=False) for n in ("spot", "c", "kind"))
            word = spot >= 0
            code = np.where(word, spot & ((1 << _CODE_BITS) - 1), 0)
            known, logs, rest = np.zeros(len(spot), np.int64), np.zeros(len(spot)), np.zeros(len(spot))
            heads = np.flatnonzero(~word)
            texts = batch.column("head").take(pa.array(heads)).flatten()
            known[heads], logs[heads], rest[heads] = (texts[inside.index(n)].to_numpy(zero_copy_only=False) for n in sums)
            left, right = code // (KINDS + 1) % (KINDS + 1), code % (KINDS + 1)
            own = np.where(batch.column("kind").is_valid(), own, code // (KINDS + 1) ** 2)
            # The class before: of the neighbour in the text, or of the row before, which is that neighbour.
            from_left = np.where(left == unknown, np.append(last, own[:-1]), left)[word]
            last, own, right = own[-1], own[word], right[word]
            known[word] = c[word] > 0
            logs[word] = np.log10(c[word] + HALF)
            rest[word] = transitions[from_left, own] - totals[own]
            ahead = np.flatnonzero(word)[right != unknown]
            rest[ahead] += transitions[own[right != unknown], right[right != unknown]]
            upto = heads[0] if len(heads) else len(word)
            if held:
                held = held[0], *(h + x[:upto].sum(keepdims=True) for h, x in zip(held[1:], (known, logs, rest), strict=True))
            if len(heads):
                if held:
                    yield finished(*held)
                added = [np.add.reduceat(x, heads) for x in (known, logs, rest)]
                yield finished([x[:-1] for x in texts[:2]], *(x[:-1] for x in added))
                held = [x[-1:] for x in texts[:2]], *(x[-1:] for x in added)
        if held:
            yield finished(*held)

    def finished(texts, known, logs, rest):
        numbers = [pa.array(known, pa.int64()), pa.array(logs), pa.array(rest)]
        return pa.RecordBatch.from_arrays([*texts, *numbers], inside)

    fields = (
        "row bigint, h bigint, spot bigint, "
        f"head struct<doc_id: {kind}, n_tokens: bigint, known: bigint, logs: double, rest: double>"
    )
    emitted = docs.mapInArrow(run, fields)
    joined = emitted.join(words, "h", "left").select(*[n for n in names if n != "h"], "c", "kind")
    dealt = joined.repartition("row").sortWithinPartitions("row", "spot")
    summed = dealt.mapInArrow(back, f"doc_id {kind}, n_tokens bigint, known bigint, logs double, rest double")
    whole = float(np.log10(model.tokens + HALF * (model.types + 1)))
    end = float(np.log10(model.ends + HALF))
    score = F.col("logs") + F.col("rest")
    return summed.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + int(model.ends > 0)).alias("n_known"),
        (F.col("logs") + end - F.col("n_tokens") * whole).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
