import random
import re

import pytest
from pyspark.sql import functions as F

from newsloom.llm import jaccard
from newsloom.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(docs):
    """Components by comparing every two sets."""
    sets = [shingle_set(t) for _, t in docs]
    label = list(range(len(docs)))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            common = len(a & b)
            if common and 100 * common >= 75 * (len(a) + len(b) - common):
                label[find(i)] = find(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(docs[i][0])
    return sorted((docs[i][0], len(sets[i]), min(groups[find(i)])) for i in range(len(docs)))


def corpus(seed, n, family, most_edits):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = pick.choices(vocabulary, k=30)
    docs = [" ".join(pick.choices(vocabulary, k=pick.randint(1, 80))) for _ in range(n)]
    docs += [" ".join(pick.choices(vocabulary, k=20) + passage + pick.choices(vocabulary, k=20)) for _ in range(n // 2)]
    base = pick.choices(vocabulary, k=70)
    for _ in range(family):
        words = list(base)
        for _ in range(pick.randint(0, most_edits)):
            at = pick.randrange(len(words))
            words[at : at + 1] = pick.choice([[], ["New"], [words[at], "in"]])
        docs.append(" ".join(words))
    docs += pick.choices(docs, k=n // 4) + ["", None, " \t", "One two", "one TWO", "a b c d", "a b c d e", "é É"]
    pick.shuffle(docs)
    return [(i * 3, t) for i, t in enumerate(docs)]


def found(spark, docs, parts=4):
    table = spark.createDataFrame(
        [(i, t, "x", 1) for i, t in docs], "doc_id long, text string, class string, n int"
    ).repartition(parts)
    rows = jaccard.jaccard_components(table).collect()
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed, 60, 60, 8)
    assert found(spark, docs) == brute(docs)


def test_large_families_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    docs = corpus(3, 30, 120, 6)
    assert found(spark, docs) == brute(docs)


def test_threshold_is_inclusive(spark):
    # Two sets of 7 shingles that share 6: 6 of 8 is exactly three quarters.
    a = "a b c d e f g h i j k"
    b = "a b c d e f g h i j z"
    docs = [(1, a), (2, b), (3, "q " * 11)]
    assert found(spark, docs) == brute(docs) and brute(docs)[1] == (2, 7, 1)


def test_copies_nulls_and_empty_tables(spark):
    schema = "doc_id long, text string"
    rows = [(None, "p q r s t"), (5, "p q r s t"), (None, None), (7, "  "), (7, "  "), (8, "u v"), (8, "u v")]
    result = jaccard.jaccard_components(spark.createDataFrame(rows, schema)).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_copies) for r in result), key=str)
    assert got == sorted(
        [(None, 1, 5, 2), (5, 1, 5, 2), (None, 0, None, 1), (7, 0, 7, 1), (7, 0, 7, 1), (8, 1, 8, 2), (8, 1, 8, 2)], key=str
    )
    assert jaccard.jaccard_components(spark.createDataFrame([], schema)).count() == 0


def test_very_long_text(spark):
    words = [f"w{i}" for i in range(30_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:25_000])), (3, " ".join(words[:10_000]))]
    assert found(spark, docs) == [(1, 29_996, 1), (2, 24_996, 1), (3, 9_996, 3)]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (None, 3)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "a long, b long")).agg(F.count("*")).first()[0] == 0


def test_many_rows_without_or_of_one_id(spark):
    """One text a class is held, however many rows share an id."""
    docs = corpus(9, 60, 8, 3)
    for ids in ([None] * len(docs), [7] * len(docs)):
        rows = [(i, t) for i, (_, t) in zip(ids, docs, strict=True)]
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        classes = jaccard._sketch_and_sets(table, 5).filter("class IS NOT NULL").select("class").distinct()
        assert jaccard._held_texts(table, classes, 5).count() == classes.count() == len({shingle_set(t) for _, t in docs} - {frozenset()})
        got = jaccard.jaccard_components(table).collect()
        assert {r.component_id for r in got if r.n_shingles} == {ids[0]}
        expected = sorted(len(shingle_set(t)) for _, t in docs)
        assert sorted(r.n_shingles for r in got) == expected
