import math
import random

import numpy as np
import pytest

from newsloom.llm import negatives

NAN = float("nan")
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, wanted=5):
    kept = [
        (n, i, [math.floor(256 * x) for x in v], label)
        for n, (i, v, label) in enumerate(rows)
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for n, i, v, label in kept:
        if i is None or i % 100:
            continue
        scored = [
            (sum(a * b for a, b in zip(v, w, strict=True)), j, other)
            for m, j, w, other in kept
            if m != n and len(w) == len(v)
        ]
        for top, j, _ in sorted((r for r in scored if r[2] == label), key=order)[:positives]:
            window = [r for r in scored if r[2] != label and 80 * top <= 100 * r[0] <= 100 * top]
            for rank, (score, k, _) in enumerate(sorted(window, key=order)[:wanted], 1):
                out.append((i, j, rank, k, top, score))
    return sorted(out, key=str)


def found(spark, rows, schema=SCHEMA):
    table = spark.createDataFrame(rows, schema).repartition(3)
    return sorted((tuple(r) for r in negatives.hard_negatives(table).collect()), key=str)


def vectors(seed, n, dims=6):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        v = [pick.gauss(0.4, 0.2) for _ in range(dims)]
        rows.append((i, [float(np.float32(x)) for x in v], pick.randrange(3)))
    return rows


@pytest.mark.parametrize("block", [4096, 40])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    rows = vectors(1, 420)
    expected = brute(rows)
    assert len(expected) > 50
    assert found(spark, rows) == expected


def test_odd_rows(spark):
    rows = vectors(2, 130)
    one, other = rows[7][1], rows[8][1]
    # Ties, repeated rows and ids, rows without id, other lengths, negative and zero scores.
    rows += [(900 + i, one, i % 2) for i in range(8)] + [rows[0], rows[100], (100, other, 1)]
    rows += [(None, one, 0), (None, one, 1), (200, [0.1, 0.2], 0), (201, [0.1, 0.2], 0), (202, [0.1, 0.2], 1)]
    rows += [(300, [], 0), (301, [], 0), (302, [], 1), (400, [-0.5] * 6, 0), (500, [0.0] * 6, 0)]
    rows += [(600, None, 1), (700, [NAN] * 6, 1), (800, [None] * 6, 1), (1000, one, None)]
    expected = [r for r in brute(rows) if r[0] != 300]  # empty vectors have no score
    assert found(spark, rows) == expected


def test_clashing_columns_and_empty_table(spark):
    schema = SCHEMA + ", row string, dims int, cells int, rank int"
    rows = [(*r, "x", 1, 2, 3) for r in vectors(3, 120)]
    assert found(spark, rows, schema) == brute([r[:3] for r in rows])
    assert found(spark, [], schema) == []


@pytest.mark.parametrize("largest", [3, 300, 10**5, 6 * 10**7])
def test_products_are_exact(largest):
    pick = np.random.default_rng(largest)
    left = pick.integers(-largest, largest + 1, (40, 130))
    right = pick.integers(-largest, largest + 1, (50, 130))
    left[0], right[0], right[1] = largest, largest, -largest
    primes = negatives.primes_for(130 * largest**2)
    assert (negatives.exact_products(left, right, primes) == left @ right.T).all()


def test_too_large_components(spark):
    with pytest.raises(ValueError, match="too large"):
        found(spark, [(0, [1e30], 1), (1, [1.0], 1)])
