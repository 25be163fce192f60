import numpy as np
import pytest

from newsloom.operators import keyword_blocks
from newsloom.operators.keyword_blocks import match_many, score_many
from newsloom.operators.similarity import score_vectors

DIM = 6
SCHEMA = "article_id long, embedding array<float>"
KEYWORDS = "keyword string, embedding array<float>"


def unit(x):
    x = x.astype("float64")
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros(x.shape), where=n > 0)


def grouped(rng, n, spread):
    """Vectors around a few directions, most of them around the first."""
    centres = rng.normal(size=(5, DIM))
    return (centres[np.minimum(rng.geometric(0.6, n) - 1, 4)] + rng.normal(size=(n, DIM)) * spread).astype("float32")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    both = grouped(rng, 700, 0.1)
    vectors, keywords = both[:200].copy(), both[200:].copy()
    vectors[7] = 0
    keywords[3] = 0
    keywords[5] = keywords[4]
    articles = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], SCHEMA)
    words = spark.createDataFrame([(f"k{i}", v.tolist()) for i, v in enumerate(keywords)], KEYWORDS)
    return articles, words, unit(vectors) @ unit(keywords).T


def test_best_in_blocks_equals_brute_force(data):
    articles, words, cosine = data
    found = score_many(articles.repartition(3), words, block=64, group=32)
    assert found.columns == ["article_id", "embedding", "similarity"]
    got = {r.article_id: r.similarity for r in found.collect()}
    assert got == pytest.approx(dict(enumerate(cosine.max(axis=1))))
    plain = {r.article_id: r.similarity for r in score_vectors(articles, words).collect()}
    assert got == pytest.approx(plain)


def test_matches_in_blocks_equal_brute_force(data):
    articles, words, cosine = data
    rows = match_many(articles, words, 0.9, block=64, group=32).collect()
    got = {(r.article_id, r.keyword): r.similarity for r in rows}
    assert len(got) == len(rows)
    assert got == pytest.approx({(i, f"k{k}"): cosine[i, k] for i, k in zip(*np.nonzero(cosine >= 0.9), strict=True)})


def test_far_blocks_are_skipped(spark, monkeypatch):
    """Six directions far apart, 64 keywords each: the blocks of other directions are hardly visited."""
    rng = np.random.default_rng(2)
    near = np.repeat(np.eye(DIM), 94, axis=0) + rng.normal(size=(94 * DIM, DIM)) * 0.05
    words = [(f"k{i}", v.tolist()) for i, v in enumerate(near) if i % 94 < 64]
    rows = [(i, v.tolist()) for i, v in enumerate(near) if i % 94 >= 64]
    articles, keywords = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(words, KEYWORDS)
    visits = []
    met = keyword_blocks._meet
    monkeypatch.setattr(keyword_blocks, "_meet", lambda v, *rest: visits.append(v.count()) or met(v, *rest))
    got = {r.article_id: r.similarity for r in score_many(articles, keywords, block=64).collect()}
    cosine = unit(np.array([v for _, v in rows])) @ unit(np.array([v for _, v in words])).T
    assert got == pytest.approx({i: c.max() for (i, _), c in zip(rows, cosine, strict=True)}, abs=1e-6)
    assert visits[0] == len(rows)
    assert visits[1] < len(rows)


def test_one_keyword_and_one_hot_direction(spark):
    """A block that all vectors visit is met in many groups."""
    articles = spark.createDataFrame([(1, [1.0, i / 500]) for i in range(500)], SCHEMA)
    words = spark.createDataFrame([("k", [2.0, 0.0])], KEYWORDS)
    rows = score_many(articles, words, group=16).collect()
    assert len(rows) == 500
    assert all(r.similarity == pytest.approx(1 / np.hypot(1, r.embedding[1])) for r in rows)


def test_odd_vectors_and_keywords(spark):
    rows = [(0, [1.0]), (1, [0.0, 2.0]), (1, [0.0, 2.0]), (None, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [])]
    articles = spark.createDataFrame(rows, SCHEMA)
    words = [("a", [0.0, 1.0]), ("b", None), ("c", [None, 1.0]), ("d", [float("nan"), 1.0]), (None, [0.0, 3.0]), ("e", [])]
    keywords = spark.createDataFrame(words, KEYWORDS)
    found = score_many(articles, keywords).collect()
    got = sorted((str(r.article_id), r.similarity) for r in found)
    assert got == [("0", None), ("1", 1.0), ("1", 1.0), ("3", None), ("4", None), ("5", None), ("None", 0.0)]
    matched = sorted((r.article_id, str(r.keyword)) for r in match_many(articles, keywords, 0.5).collect())
    assert matched == [(1, "None"), (1, "None"), (1, "a"), (1, "a")]
    assert match_many(articles.limit(0), keywords, 0.5).count() == 0
    assert score_many(articles.limit(0), keywords).count() == 0
    with pytest.raises(ValueError, match="empty"):
        score_many(articles, keywords.limit(0))
    with pytest.raises(ValueError, match="length"):
        score_many(articles, keywords.union(spark.createDataFrame([("z", [1.0, 2.0, 3.0])], KEYWORDS)))
