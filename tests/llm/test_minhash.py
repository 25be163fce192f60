import random
import re

import numpy as np
import pytest

from newsloom.llm import minhash

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


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
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                label[find(i)] = find(j)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(docs[i][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((docs[i][0], len(sets[i]), least[find(i)]) for i in range(len(docs))), key=str)


def corpus(seed, n=60, families=3, members=25):
    """Unlike texts, texts with a common passage, and families of texts that drift apart."""
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = pick.choices(vocabulary, k=60)
    docs = [" ".join(pick.choices(vocabulary, k=pick.randint(1, 80))) for _ in range(n)]
    docs += [" ".join(pick.choices(vocabulary, k=12) + passage + pick.choices(vocabulary, k=12)) for _ in range(n)]
    for _ in range(families):
        words = pick.choices(vocabulary, k=120)
        for _ in range(members):
            docs.append(" ".join(words))
            for _ in range(pick.randint(0, 4)):
                words[pick.randrange(len(words))] = pick.choice(vocabulary)
    docs += pick.choices(docs, k=n // 3) + ["", None, " \t\r", "One two", "one\x0btwo", "a b c", "a b c d", "é É"]
    pick.shuffle(docs)
    return [(i * 3, t) for i, t in enumerate(docs)]


def rows(spark, docs, schema="doc_id long, text string, row int, n string, bucket int, node int", parts=4):
    table = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in docs], schema).repartition(parts)
    return minhash.near_duplicates(table).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    got = rows(spark, docs)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_small_blocks(spark, monkeypatch):
    # Many blocks a family, and few bands, so that links hang on single buckets.
    monkeypatch.setattr(minhash, "BLOCK_MARKS", 7)
    monkeypatch.setattr(minhash, "BLOCK_SETS", 3)
    docs = corpus(5, n=30, families=2, members=30)
    got = rows(spark, docs)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(docs)


def test_links_beside_the_leader(spark):
    # One bucket: a leads, b links with a, c links with b alone, d with nobody.
    words = [f"w{i}" for i in range(200)]
    texts = [words, words[:9] + ["x"] + words[10:], words[:9] + ["x"] + words[10:], ["y"] * 4 + words[60:]]
    texts[1][190:] = [f"z{i}" for i in range(5)]
    texts[2][170:] = [f"z{i}" for i in range(10)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    table = spark.createDataFrame(docs, "row long, text string")
    found = minhash._read_texts(table.withColumn("doc_id", table["row"]), 4, 40, 5, 1)
    members = spark.createDataFrame([(9, i, 0) for i in range(4)], "bucket long, node long, leader long")
    links = minhash._bucket_links(members, found.select("row", "n", "marks"), table, 4, 80, 200)
    sets = [shingle_set(t) for _, t in docs]
    near = {
        (i, j) for i in range(4) for j in range(4) if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    }
    assert (0, 1) in near and (1, 2) in near and (0, 2) not in near and (0, 3) not in near
    assert {tuple(sorted(r)) for r in links.collect()} == near


def test_nulls_repeats_and_copies(spark):
    text = " ".join(f"x{i}" for i in range(40))
    near = text + " tail"
    alone = "only rows without an id " * 3
    docs = [(7, text), (7, text), (5, near), (None, text), (None, alone), (None, alone + "more"), (9, ""), (9, None), (None, "")]
    got = rows(spark, docs)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(docs)
    kept = [(r.doc_id, r.n_shingles > 0) for r in got if r.kept]
    # One row of each group, all rows of the empty texts.
    assert sorted(kept, key=str) == sorted([(5, True), (None, True), (9, False), (9, False), (None, False)], key=str)
    assert sorted(r.n_copies for r in got if r.component_id == 5) == [1, 3, 3, 3]


def test_empty_table_and_text_ids(spark):
    assert rows(spark, []) == []
    table = spark.createDataFrame([("b", "one two three four five"), ("a", "One two three four five")], "doc_id string, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(table).collect()} == {
        ("a", "a", True),
        ("b", "a", False),
    }


def test_long_text(spark):
    words = [f"w{i % 997}x{i}" for i in range(60_000)]
    changed = words.copy()
    changed[500] = "other"
    got = rows(spark, [(2, " ".join(words)), (1, " ".join(changed)), (3, "short text of six small words")])
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 3)}


def test_signatures_estimate_similarity():
    pick = np.random.default_rng(1)
    a = np.unique(pick.integers(0, 1 << 64, 4000, dtype=np.uint64))
    b = np.concatenate([a[:3000], np.unique(pick.integers(0, 1 << 64, 1000, dtype=np.uint64))])
    both = minhash.signatures([a, b], 3, 512)
    share = (both[0] == both[1]).mean()
    assert abs(share - 0.6) < 0.1


def test_star_components(spark):
    pick = random.Random(8)
    links = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(1, 50)]
    links += [(pick.randrange(300, 400), pick.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    table = spark.createDataFrame(links, "a long, b long").repartition(3)
    got = {r.node: r.root for r in minhash.star_components(table).collect()}
    label = {n: n for pair in links for n in pair}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    single = {n for n in label if not any(n in pair and pair[0] != pair[1] for pair in links)}
    assert got == {n: r for n, r in label.items() if n not in single}
