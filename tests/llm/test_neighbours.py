import numpy as np
import pytest

from newsloom.llm import neighbours


def brute(rows, top=20):
    """Exact answers of the usable rows whose id is divisible by 20."""
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows]
    out = {}
    for q, v in good:
        if q % 20 == 0:
            scored = sorted(((-float(v @ w), i) for i, w in good if i != q))[:top]
            out[q] = [(i, -s) for s, i in scored]
    return out


def run(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    index = neighbours.build(table)
    answers = neighbours.search(index, table.filter("vec_id % 20 = 0"), **options).collect()
    out = {}
    for r in sorted(answers, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(found, want):
    hit = sum(len({i for i, _ in found.get(q, [])} & {i for i, _ in w}) for q, w in want.items())
    return hit / sum(map(len, want.values()))


def test_recall_and_scores(spark):
    random = np.random.default_rng(3)
    centers = random.normal(size=(6, 24))
    points = [(i, (centers[i % 6] + random.normal(size=24)).tolist()) for i in range(900)]
    want = brute(points)
    found = run(spark, [(i, v, 0) for i, v in points])
    assert recall(found, want) >= 0.95
    vectors = {i: np.array(v, np.float32).astype(np.float64) for i, v in points}
    for q, answers in found.items():
        assert [s for _, s in answers] == sorted((s for _, s in answers), reverse=True)
        assert all(abs(s - vectors[q] @ vectors[i]) < 1e-9 for i, s in answers)


def test_few_rows_are_all_found_and_lengths_differ(spark):
    points = [(0, [1.0, 0.0]), (1, [3.0, 0.1]), (2, [0.5, 0.5]), (20, [0.0, 2.0]), (5, [-1.0, 0.0])]
    found = run(spark, [(i, v, 0) for i, v in points])
    want = brute(points)
    assert {q: [i for i, _ in a] for q, a in found.items()} == {q: [i for i, _ in a] for q, a in want.items()}


def test_copies_tie_by_id_and_do_not_crowd_out(spark):
    same = [(i, [1.0, 2.0, 0.0]) for i in range(100)]
    others = [(1000 + i, [0.1 * i, 1.0, 1.0]) for i in range(10)]
    found = run(spark, [(i, v, 0) for i, v in same + others])
    assert [i for i, _ in found[40]] == [i for i in range(21) if i != 40][:20]
    assert [i for i, _ in found[0]] == list(range(1, 21))
    want = brute(same + others)
    assert [i for i, _ in found[1000]] == [i for i, _ in want[1000]]


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [nan, 1.0]), (100, [inf, 1.0]), (120, [1.0]), (140, []), (None, [1.0, 1.0])]
    good = [(0, [1.0, 1.0]), (1, [1.0, 0.5]), (160, [0.2, -0.0]), (161, [0.2, 0.0])]
    found = run(spark, [(i, v, 0) for i, v in bad + good])
    assert set(found) == {0, 160}
    assert [i for i, _ in found[0]] == [1, 160, 161] and [i for i, _ in found[160]] == [0, 1, 161]


@pytest.mark.parametrize("rows", [[], [(0, None, 1)], [(0, [1.0], 1)]])
def test_nothing_to_find(spark, rows):
    assert run(spark, rows) == {}


def test_repeated_ids_are_rows_of_their_own(spark):
    found = run(spark, [(0, [1.0, 0.0], 0), (3, [1.0, 0.2], 0), (3, [0.5, 0.2], 0)])
    assert [i for i, _ in found[0]] == [3, 3]


def test_no_more_answers_than_copies_are_kept(spark):
    table = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError, match="copies"):
        neighbours.search(neighbours.build(table), table.filter("vec_id = 0"), top=25)
    index = neighbours.build(table, copies=27)
    found = neighbours.search(index, table.filter("vec_id = 0"), top=25).orderBy("rank").collect()
    assert [r.vec_id for r in found] == list(range(1, 26))
