import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsloom.llm import mixing

SCHEMA = "doc_id long, source string, text string, size int, copies int, _name string"


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute(docs):
    """Targets by sharing again and again; documents in seeded order while half of their words fit."""
    names = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    own = {n: sum(size_of(t) for _, s, t in docs if s == n) for n in names}
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    aim, free, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(own.values())
    while free and left > 1e-9:
        total = sum(weight[n] for n in free)
        for n in list(free):
            aim[n] += left * weight[n] / total
        left = 0.0
        for n in list(free):
            if aim[n] >= 2 * own[n]:
                left += aim[n] - 2 * own[n]
                aim[n] = 2.0 * own[n]
                free.discard(n)
    out = []
    for n in names:
        whole = min(2, int(aim[n] / own[n] + 1e-9)) if own[n] else 0
        rest, units = aim[n] - whole * own[n], {}
        for i, s, t in docs:
            if s == n and size_of(t):
                parts = ["mix", *([str(i)] if i is not None else []), t]
                units.setdefault(hashlib.md5("|".join(parts).encode()).hexdigest(), []).append((i, t))
        at = 0
        for key in sorted(units):
            words = sum(size_of(t) for _, t in units[key])
            more = int(rest > 1e-6 and at + words / 2 <= rest)
            at += words
            out += [(i, n, size_of(t), min(2, whole + more)) for i, t in units[key]]
        out += [(i, n, 0, 0) for i, s, t in docs if s == n and not size_of(t)]
    return aim, Counter(out)


def table(spark, docs):
    return spark.createDataFrame([(*d, 5, 5, "x") for d in docs], SCHEMA).repartition(3)


def corpus(seed, n):
    pick = random.Random(seed)
    names = ["b", "a", "é", None, "hot", "hot", "hot", "tiny"]
    docs = [(i, pick.choice(names[:7]), "w " * pick.randint(0, 60)) for i in range(n)]
    return docs + [(n, "tiny", "one two"), (n + 1, "a", None), (n + 2, "blank", " "), (None, "b", "x y z"), (7, "a", "again a"), (7, "a", "again a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs = corpus(seed, 300)
    mixed = mixing.mix(table(spark, docs))
    aim, want = brute(docs)
    assert {k: round(v, 6) for k, v in mixed.targets.items()} == {k: round(v, 6) for k, v in aim.items()}
    rows = mixing.taken(table(spark, docs), mixed)
    assert rows.columns == ["doc_id", "source", "text", "size", "copies", "_name", "size_", "copies_"]
    got = Counter((r.doc_id, r.source, r.size_, r.copies_) for r in rows.collect())
    assert got == want
    taken = Counter()
    for (_, source, size, copies), n in got.items():
        taken[source] += n * size * copies
    for source in aim:
        longest = max(size_of(t) for _, s, t in docs if s == source)
        assert abs(taken[source] - aim[source]) <= longest / 2 + 1e-6


def test_mixture_repeats_rows_and_reruns_agree(spark):
    docs = corpus(3, 120)
    frame = table(spark, docs)
    one, two = (Counter(r.doc_id for r in mixing.mixture(frame, mixing.mix(frame)).collect()) for _ in range(2))
    assert one == two and max(one[i] for i in range(100) if i != 7) == 2
    assert mixing.mixture(frame, mixing.mix(frame)).columns == frame.columns


def test_overlapping_sources_share_patterns(spark):
    docs = [(i, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b", "b"], "w " * 10) for i in range(90)]
    frame = spark.createDataFrame(docs, "doc_id long, source array<string>, text string")
    mixed = mixing.mix(frame, weights=(1.0, 2.0), share=1.0)
    # The 900 words go 300 to 600: half of the pattern of both is a's own at most.
    assert mixed.targets == {"a": 300.0, "b": 600.0}
    rows = mixing.taken(frame, mixed).groupBy("source").agg(F.sum(F.col("size") * F.col("copies"))).collect()
    assert sum(r[1] for r in rows) == 900 and {len(r[0]): r[1] for r in rows if len(r[0]) == 1}[1] in (300, 0)
    assert max(r.copies for r in mixing.taken(frame, mixed).collect()) == 1
    empty = spark.createDataFrame([(1, None, "a b"), (2, [], "c d")], frame.schema)
    assert mixing.mix(empty).targets == {None: 6.0}


def test_flow_is_of_least_cost():
    # Pattern 0 serves both sources; the second copy of a pattern costs more than the first of another.
    sent = mixing.flow([10, 10, 10], [[0, 1], [0], [1]], [15, 15], 2)
    assert [sum(s) for s in sent] == [10, 10, 10]
    assert sent[0][0] + sent[1][0] == 15 and sent[0][1] + sent[2][0] == 15
    more = mixing.flow([10, 10], [[0], [1]], [25, 5], 2)
    assert more == [[20], [5]]


def test_too_many_patterns_and_empty_tables(spark, monkeypatch):
    none = table(spark, [])
    mixed = mixing.mix(none)
    assert mixed.targets == {} and mixing.taken(none, mixed).count() == 0
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 1)
    with pytest.raises(ValueError):
        mixing.mix(table(spark, [(1, "a", "x"), (2, "b", "y")]))
