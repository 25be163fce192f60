import hashlib
import math
import random

import numpy as np
import pytest

from newsloom.llm import centroids

INF, NAN = float("inf"), float("nan")


def brute(rows, k, rounds, dims, scale):
    """All distances to all centroids, in Python integers."""
    kept = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    middle = [v for _, v in sorted(kept, key=name)[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, members in groups.items():
            middle[n] = [sum(part) // len(members) for part in zip(*members, strict=True)]
    return sorted((str(i), *reversed(nearest(v))) for i, v in kept), middle


def table(spark, rows, schema="vec_id long, embedding array<float>", parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def found(clustering):
    return sorted((str(r.vec_id), r.cluster, r.distance) for r in clustering.rows.collect())


def vectors(seed, n, dims):
    pick = random.Random(seed)
    middles = [[pick.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    near = [[x + pick.gauss(0, 0.2) for x in pick.choice(middles)] for _ in range(n)]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(near)]


@pytest.mark.parametrize(("k", "dims"), [(16, 8), (40, 4), (1, 3)])
def test_equals_brute_force(spark, k, dims):
    rows = vectors(3, 250, dims)
    rows += rows[:20] + [(400, rows[0][1]), (None, rows[1][1]), (None, rows[2][1])]
    rows += [(500, None), (501, [0.5] * (dims + 1)), (502, [None] * dims), (503, [NAN] * dims), (504, [INF] * dims), (505, [])]
    got = centroids.cluster(table(spark, rows), k=k, dims=dims)
    expected, middle = brute(rows, k, 3, dims, 64)
    assert found(got) == expected
    assert got.centroids == middle


def test_ties_and_empty_clusters(spark):
    # Equal vectors give equal centroids: the smaller number takes all, the other keeps its place.
    rows = [(i, [float(i % 3), 0.0]) for i in range(12)]
    got = centroids.cluster(table(spark, rows), k=8, dims=2)
    expected, middle = brute(rows, 8, 3, 2, 64)
    assert found(got) == expected and got.centroids == middle
    assert len({c for _, c, _ in expected}) < 8


def test_search_is_exact_and_skips_centroids():
    pick = np.random.default_rng(4)
    middle = pick.integers(-400, 400, (300, 3))
    points = np.concatenate([pick.integers(-400, 400, (500, 3)), middle, middle[::2] + 1])
    number, best, compared = centroids.nearest(points, centroids.build_tree(middle))
    gaps = ((points[:, None] - middle[None]) ** 2).sum(axis=2)
    assert (best == gaps.min(axis=1)).all() and (number == gaps.argmin(axis=1)).all()
    assert compared.mean() < 100


def test_inertia(spark):
    rows = vectors(5, 60, 4)
    got = centroids.cluster(table(spark, rows), k=5, dims=4)
    facts = centroids.with_inertia(got).collect()
    assert {r.inertia for r in facts} == {sum(r.distance for r in facts)}
    for r in facts:
        assert r.cluster_inertia == sum(o.distance for o in facts if o.cluster == r.cluster)
        text = ",".join(map(str, got.centroids[r.cluster]))
        assert r.centroid_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_few_rows_and_other_columns(spark):
    schema = "vec_id long, embedding array<float>, cells string, cluster int, number int"
    rows = [(1, [1.0, 0.0], "x", 9, 9), (2, [0.0, 1.0], None, None, 9)]
    got = centroids.cluster(table(spark, rows, schema), k=16, dims=2)
    assert sorted(r.cluster for r in centroids.with_inertia(got).collect()) == [0, 1]
    empty = centroids.with_inertia(centroids.cluster(table(spark, [], schema), k=16, dims=2))
    assert empty.collect() == []
    assert empty.columns == ["vec_id", "cluster", "distance", "compared", "cluster_inertia", "inertia", "centroid_sha256"]


def test_too_large_components(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(table(spark, [(1, [1e30, 1.0]), (2, [1.0, 1.0])]), k=2, dims=2)
