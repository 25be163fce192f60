import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import brown

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOICES = [["ka", "to", "mi", "ra", "sel", "dun"], ["schu", "berg", "ung", "hei", "tor", "lin"]]


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD)), None]


def corpus(n=400):
    pick = random.Random(3)
    return [
        (i, " ".join("".join(pick.choices(VOICES[i % 2], k=pick.randint(1, 3))) for _ in range(pick.randint(1, 60))))
        for i in range(n)
    ]


ODD = [(1001, None), (1002, ""), (1003, " \t"), (1004, "KATO, Kato! kato"), (1004, "new words"), (None, "ka ka"), (1005, "mi " * 30_000)]


@pytest.fixture(scope="module")
def fitted(spark):
    train = [*corpus(), (2000, None), (2001, "Kato mi.")]
    table = spark.createDataFrame([(i, t, 7) for i, t in train], "doc_id long, text string, h int").repartition(3)
    return train, *brown.fit(table)


def scored(spark, model, counts, docs):
    table = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, row int").repartition(4)
    return brown.scores(table, model, counts).collect()


def test_counts_and_base_scores_equal_brute_force(spark, fitted):
    train, model, counts = fitted
    seen = Counter(t for _, text in train for t in tokens(text))
    total, kinds = sum(seen.values()), len(seen)
    assert (model.tokens, model.types, model.ends) == (total, kinds, len(train))
    docs = corpus(40) + ODD
    want = sorted(
        (str(i), len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)),
         round(sum(math.log10((seen[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens(t)), 4))
        for i, t in docs
    )
    rows = scored(spark, model, counts, docs)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in rows) == want
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in rows)


def hashed(words):
    """Hash and ending of each word."""
    data = np.frombuffer("\n".join(words).encode(), np.uint8)
    hashes, endings, _ = brown._hashed_words(data, np.array([0, len(data)]))
    return dict(zip(words, zip(hashes.view(np.int64).tolist(), endings.tolist(), strict=True), strict=True))


def test_scores_equal_brute_force(spark, fitted):
    _, model, counts = fitted
    docs = corpus(40) + ODD
    of = hashed(sorted({w for _, t in docs for w in tokens(t)[:-1]}))
    words = {r.h: (r.c, r.kind) for r in counts.collect()}

    def score(text):
        now, total = brown.CLASSES, 0.0
        for word in tokens(text)[:-1]:
            h, ending = of[word]
            c, kind = words.get(h, (0, int(model.endings[ending])))
            total += model.transitions[now, kind] + math.log10(c + 0.5) - model.emission_totals[kind]
            now = kind
        return total + model.transitions[now, brown.CLASSES]

    want = sorted((str(i), round(score(t), 4)) for i, t in docs)
    assert sorted((str(r.doc_id), round(r.score, 4)) for r in scored(spark, model, counts, docs)) == want


@pytest.mark.parametrize("kept", [0, 1, 60])
def test_scores_do_not_depend_on_what_travels_to_the_tasks(spark, fitted, kept):
    _, model, counts = fitted
    some = np.sort(np.argsort(-model.lexicon.counts, kind="stable")[:kept])
    few = model._replace(lexicon=brown.Lexicon(*(part[some] for part in model.lexicon)))
    docs = corpus(30) + ODD
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7 if kept else 1000)
    try:
        one, two = (
            sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 4)) for r in rows)
            for rows in (scored(spark, model, counts, docs), scored(spark, few, counts, docs))
        )
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert one == two


def test_probabilities_sum_to_one(fitted):
    _, model, counts = fitted
    assert np.allclose((10**model.transitions).sum(axis=1), 1)
    # Emissions of a class: its words' counts plus a half each, and a half for an unknown one.
    mass = Counter()
    for row in counts.collect():
        mass[row.kind] += row.c + 0.5
    assert all(abs(mass[k] + 0.5 - 10 ** model.emission_totals[k]) < 1e-6 * (mass[k] + 1) for k in range(brown.CLASSES))


def test_every_repeated_word_is_exchanged(spark, monkeypatch):
    """One round over words that are no items equals a word-by-word version in plain Python."""
    monkeypatch.setattr(brown, "WORDS", 6)
    train = corpus(120)
    table = spark.createDataFrame(train, "doc_id long, text string").repartition(3)
    before, start = brown.fit(table, rounds=0)
    after, moved = brown.fit(table, rounds=1)
    start, moved = ({r.h: (r.c, r.kind) for r in rows.collect()} for rows in (start, moved))
    of = hashed(sorted({w for _, t in train for w in tokens(t)[:-1]}))
    edge, kinds = brown.CLASSES, brown.KINDS
    cells, left, right = np.zeros((kinds, kinds)), {}, {}
    for _, text in train:
        line = [of[w][0] for w in tokens(text)[:-1]]
        classes = [edge, *(start[h][1] for h in line), edge]
        for at, h in enumerate([*line, None]):
            cells[classes[at], classes[at + 1]] += 1
            if h is not None:
                left.setdefault(h, Counter())[classes[at]] += 1
                right.setdefault(h, Counter())[classes[at + 2]] += 1

    def likelihood(h, k, home):
        own_r, own_l = (right[h], left[h]) if k == home else (Counter(), Counter())
        n = start[h][0]
        out = sum(c * math.log(max(cells[k, x] - own_r[x], 0) + 0.5) for x, c in right[h].items())
        out += sum(c * math.log(max(cells[x, k] - own_l[x], 0) + 0.5) for x, c in left[h].items())
        gone = n if k == home else 0
        room = 0.5 * kinds
        return out - n * (math.log(cells[k].sum() - gone + room) + math.log(cells[:, k].sum() - gone + room))

    items = set(before.lexicon.hashes[before.lexicon.items].view(np.int64).tolist())
    changed = 0
    for h, (c, home) in start.items():
        kind = moved[h][1]
        if h in items or c < brown.LEAST_COUNT:
            assert kind == home
            continue
        every = [likelihood(h, k, home) for k in range(edge)]
        assert every[kind] >= max(every) - 1e-6
        changed += kind != home
    assert changed > 10 and len(items) == 6


def test_texts_are_read_twice_to_learn(spark):
    """Once to count words, once to write the lines of numbers; every other pass reads these."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    table = spark.createDataFrame(corpus(60), "doc_id long, text string").repartition(2)
    texts = table.select("text").mapInArrow(counted, "text string")
    texts.foreach(lambda row: None)
    one, seen.value = seen.value, 0
    brown.fit(texts)
    assert one == 60 and seen.value <= 3 * one  # and the number of texts is counted


def test_what_travels_does_not_change_classes(spark, monkeypatch):
    """Words with and without a number move alike in a round, in slices, flushes and groups of any size."""
    monkeypatch.setattr(brown, "WORDS", 6)
    table = spark.createDataFrame(corpus(120), "doc_id long, text string").repartition(3)
    whole = {r.h: (r.c, r.kind) for r in brown.fit(table, rounds=1)[1].collect()}
    sizes = {"FREQUENT": 40, "_SLICE_WORDS": 16, "_SLICE_TOKENS": 300, "_HELD": 100, "_DECIDED": 7, "_BLOCK_BYTES": 500}
    for name, size in sizes.items():
        monkeypatch.setattr(brown, name, size)
    model, rows = brown.fit(table, rounds=1)
    assert {r.h: (r.c, r.kind) for r in rows.collect()} == whole
    assert len(model.lexicon.hashes) == 40 and sum(c >= brown.LEAST_COUNT for c, _ in whole.values()) > 100
    known = {h: kind for h, (_, kind) in whole.items()}
    assert [known[h] for h in model.lexicon.hashes.view(np.int64).tolist()] == model.lexicon.kinds.tolist()


def test_places_in_a_crowded_lexicon():
    pick = np.random.default_rng(1)
    held = np.unique(np.append(pick.integers(0, 1 << 40, 500), pick.integers(0, 1 << 63, 500)).astype(np.uint64))
    held = np.append(held, np.uint64(2**64 - 1))
    find = np.concatenate([held, held + np.uint64(1), np.array([0, 2**64 - 2], np.uint64)])
    at, there = brown.Lexicon(held, held, held, held).finder()(find)
    assert there.tolist() == np.isin(find, held).tolist() and (held[at[there]] == find[there]).all()


def test_endings_look_back_over_any_number_of_marks():
    of = hashed(["ab", "ab-", "ab" + "-" * 200, "x" + "!" * 64, "x!", "-" * 300, "xab" + "9" * 7])
    assert of["ab-"][1] == of["ab" + "-" * 200][1] != of["ab"][1]
    assert of["x!"][1] == of["x" + "!" * 64][1] and of["xab" + "9" * 7][1] != of["ab-"][1]


def test_class_model_beats_words_alone_on_held_out_texts(spark, fitted):
    _, model, counts = fitted
    pick = random.Random(99)
    held_out = [
        (i, " ".join("".join(pick.choices(VOICES[i % 2], k=2)) for _ in range(50))) for i in range(20)
    ]
    rows = scored(spark, model, counts, held_out)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_exchange_separates_what_never_meets():
    counts = np.zeros((9, 9), np.int64)
    counts[:4, :4] = 5
    counts[4:8, 4:8] = 5
    counts[8, :8] = counts[:8, 8] = 1
    label = brown.exchange(counts, classes=2)
    assert len(set(label[:4])) == len(set(label[4:8])) == 1 and label[0] != label[4] and label[8] == 2


def test_exchange_never_loses_information():
    random_ = np.random.default_rng(5)
    counts = random_.poisson(0.5, (40, 40)) * random_.integers(1, 9, (40, 1))

    def information(label):
        member = np.eye(label.max() + 1)[label]
        table = member.T @ counts @ member
        return brown._xlogx(table).sum() - brown._xlogx(table.sum(0)).sum() - brown._xlogx(table.sum(1)).sum()

    values = [information(brown.exchange(counts, classes=6, rounds=k)) for k in range(5)]
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:], strict=False)) and values[-1] > values[0]


def test_nothing_learned(spark):
    model, counts = brown.fit(spark.createDataFrame([], "doc_id long, text string"))
    rows = scored(spark, model, counts, [(1, "a b"), (2, None)])
    assert sorted((r.n_tokens, r.n_known, r.base_score) for r in rows) == [(1, 0, 0.0), (3, 0, 0.0)]
    assert all(np.isfinite(r.score) for r in rows)
    assert scored(spark, model, counts, []) == []
