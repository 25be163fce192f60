import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import similarity
from newsloom.operators.similarity import (
    embed_articles,
    match_keywords,
    score_vectors,
    scoring_account,
    semantic_filter,
    unit_vector,
    with_text,
)

DIM = 8


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, DIM)).astype("float32")
    keywords = rng.normal(size=(6, DIM)).astype("float32")
    vectors[7] = 0
    articles = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)] + [(99, None)],
        "article_id long, embedding array<float>",
    )
    words = spark.createDataFrame(
        [(f"k{i}", v.tolist()) for i, v in enumerate(keywords)], "keyword string, embedding array<float>"
    )

    def unit(x):
        n = np.linalg.norm(x.astype("float64"), axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros(x.shape), where=n > 0)

    return articles, words, unit(vectors) @ unit(keywords).T


def test_best_similarity(data):
    articles, keywords, cosine = data
    got = {r.article_id: r.similarity for r in score_vectors(articles.repartition(3), keywords).collect()}
    assert got.pop(99) is None
    assert got[7] == 0.0
    assert got == pytest.approx(dict(enumerate(cosine.max(axis=1))))


def test_keywords_are_bounded_and_of_one_length(data, monkeypatch):
    articles, keywords, _ = data
    monkeypatch.setattr(similarity, "MOST_KEYWORDS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        score_vectors(articles, keywords)
    monkeypatch.undo()
    ragged = keywords.sparkSession.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "keyword string, embedding array<double>")
    with pytest.raises(ValueError, match="length"):
        score_vectors(articles, ragged)


def test_vectors_of_another_length_have_no_score(spark):
    keywords = spark.createDataFrame([("k", [0.0, 1.0])], "keyword string, embedding array<double>")
    rows = [(0, [1.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [None, 1.0]), (5, []), (6, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "article_id int, embedding array<double>").coalesce(1)
    got = {r.article_id: r.similarity for r in score_vectors(vectors, keywords).collect()}
    assert got == {0: None, 1: None, 2: 1.0, 3: None, 4: None, 5: None, 6: 0.0}
    matched = {r.article_id: r.matches for r in match_keywords(vectors, keywords, 0.5).collect()}
    assert matched[2] == ["k"] and not any(matched[i] for i in (0, 1, 3, 4, 5, 6))


def test_every_article_is_accounted_for(spark):
    keywords = spark.createDataFrame([("k", [0.0, 1.0])], "keyword string, embedding array<double>")
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [1.0])], "article_id int, embedding array<double>")
    articles = spark.createDataFrame([(i, "t" if i < 5 else " ", None) for i in range(1, 7)], "article_id int, title string, summary string")
    got = {r.outcome: r.articles for r in scoring_account(articles, vectors, keywords, 0.5).collect()}
    assert got == {"kept": 1, "below": 1, "unscored": 2, "blank": 2}


def test_matched_keywords_best_first(data):
    articles, keywords, cosine = data
    got = {r.article_id: r.matches for r in match_keywords(articles, keywords, 0.25).collect()}
    for i, row in enumerate(cosine):
        assert got[i] == [f"k{j}" for j in np.argsort(-row) if row[j] >= 0.25]
    assert got[99] in (None, [])


def test_threshold_is_inclusive_and_score_is_text(spark):
    keywords = spark.createDataFrame([("k", [1.0, 0.0])], "keyword string, embedding array<float>")
    vectors = spark.createDataFrame(
        [(1, [3.0, 4.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "article_id long, embedding array<float>"
    )
    articles = spark.createDataFrame(
        [(1, "t", "s", "0 %"), (2, " ", None, "0 %"), (3, "t", "s", "0 %")],
        "article_id long, title string, summary string, score string",
    )
    kept = semantic_filter(articles, vectors, keywords, 0.6).collect()
    assert [(r.article_id, r.score) for r in kept] == [(1, "60.0")]


def test_articles_with_their_own_vector_need_no_join(data):
    articles, keywords, cosine = data
    texts = articles.withColumns({"title": F.lit("t"), "summary": F.lit("s")})
    alone = semantic_filter(texts, None, keywords, 0.4)
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    joined = semantic_filter(texts.drop("embedding"), articles, keywords, 0.4)
    columns = ["article_id", "similarity", "score"]
    assert sorted(alone.select(columns).collect()) == sorted(joined.select(columns).collect())
    assert {r.article_id for r in alone.collect()} == {i for i, row in enumerate(cosine) if row.max() >= 0.4}


def test_scores_are_computed_once(data):
    articles, keywords, _ = data
    plan = score_vectors(articles, keywords).filter("similarity >= 0.2")._jdf.queryExecution().executedPlan()
    assert plan.toString().count("ArrowEvalPython") == 1


def test_no_keywords_is_an_error(data):
    articles, keywords, _ = data
    with pytest.raises(ValueError):
        score_vectors(articles, keywords.filter("false"))


def test_unit_vector(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [r.u for r in rows.select(unit_vector(F.col("v")).alias("u")).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]


def test_embedding_skips_blank_articles(spark):
    rows = spark.createDataFrame(
        [(1, "ab", "c"), (2, "\u00a0\n", ""), (3, None, "xyz"), (4, None, None)], "article_id long, title string, summary string"
    )

    def embed(texts):
        return np.array([[len(t), t.count("c")] for t in texts], dtype="float32")

    got = {r.article_id: r.embedding for r in embed_articles(rows, embed).collect()}
    assert got == {1: [4.0, 1.0], 3: [3.0, 0.0]}
    assert with_text(rows).count() == 2
