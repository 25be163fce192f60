"""Cosine similarity of articles to a keyword set.

Keywords are parameters of a run, of a checked number: they travel to the tasks inside the
function, and the article side is a narrow scan without any shuffle. One matrix product per
Arrow batch scores all keywords of a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import percent_text, stripped

MOST_KEYWORDS = 10_000


def unit_vector(vector: Column) -> Column:
    """Vector scaled to length one, as doubles; a zero vector stays zero."""
    values = vector.cast("array<double>")
    length = F.sqrt(F.aggregate(values, F.lit(0.0), lambda total, x: total + x * x))

    def scaled(n: Column) -> Column:
        return F.when(n > 0, F.transform(values, lambda x: x / n)).otherwise(values)

    # As an element of an array the length is computed once, not once per component.
    return F.get(F.transform(F.array(length), scaled), F.lit(0))


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)


def _similarities(vectors: pa.Array, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosine of each comparable vector to each keyword of a block, with the mask of those vectors.

    A null vector, one of another length and one with a null component are not comparable.
    """
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    known = lengths == block.shape[1]
    flat = vectors.filter(pa.array(known)).flatten().to_numpy(zero_copy_only=False)
    rows = flat.astype(np.float64).reshape(-1, block.shape[1])
    whole = ~np.isnan(rows).any(axis=1)
    known[known] = whole
    return _unit_rows(rows[whole]) @ block.T, known


def _best_of(block: np.ndarray) -> Callable[[Column], Column]:
    @F.arrow_udf("double")
    def best(vectors: pa.Array) -> pa.Array:
        scores, known = _similarities(vectors, block)
        out = np.zeros(len(known))
        out[known] = scores.max(axis=1) if len(scores) else 0.0
        return pa.array(out, mask=~known)

    return best


def _at_least(block: np.ndarray, names: list[str], threshold: float) -> Callable[[Column], Column]:
    """Keywords of a block that reach the threshold, with their similarity."""
    words = pa.array(names, pa.string())

    @F.arrow_udf("array<struct<keyword: string, similarity: double>>")
    def reached(vectors: pa.Array) -> pa.Array:
        scores, known = _similarities(vectors, block)
        row, keyword = np.nonzero(scores >= threshold)
        per_row = np.zeros(len(known), dtype=np.int32)
        per_row[known] = np.bincount(row, minlength=len(scores))
        ends = np.concatenate(([0], np.cumsum(per_row))).astype(np.int32)
        pairs = pa.StructArray.from_arrays(
            [words.take(pa.array(keyword)), pa.array(scores[row, keyword])],
            names=["keyword", "similarity"],
        )
        return pa.ListArray.from_arrays(pa.array(ends), pairs)

    return reached


def _scored_once(function):
    """Keep a later filter on the result from calling the function a second time.

    The optimiser copies a deterministic function into a filter that it moves below it.
    """
    return function.asNondeterministic()


def _keyword_rows(keywords: DataFrame, name: str, vector: str) -> tuple[list[str], np.ndarray]:
    """Names and unit vectors of all keywords, a run's parameters: at most ``MOST_KEYWORDS``.

    Null vectors are no keywords; vectors of different lengths are an error.
    """
    wanted = keywords.select(F.col(name).cast("string").alias("name"), F.col(vector).alias("vec"))
    rows = wanted.filter("vec IS NOT NULL").orderBy("name").limit(MOST_KEYWORDS + 1).collect()
    if not rows:
        raise ValueError("the keyword set is empty")
    if len(rows) > MOST_KEYWORDS:
        raise ValueError(f"more than {MOST_KEYWORDS} keywords")
    lengths = {len(row.vec) for row in rows}
    if len(lengths) > 1:
        raise ValueError(f"keyword vectors differ in length: {sorted(lengths)}")
    return [row.name for row in rows], _unit_rows(np.array([row.vec for row in rows], dtype=np.float64))


def score_vectors(
    vectors: DataFrame,
    keywords: DataFrame,
    *,
    vector: str = "embedding",
    keyword: str = "keyword",
    keyword_vector: str = "embedding",
) -> DataFrame:
    """``vectors`` with ``similarity``, the best cosine similarity to any keyword.

    It is null for a null vector, and for one whose length differs from the keywords'.
    """
    _, matrix = _keyword_rows(keywords, keyword, keyword_vector)
    return vectors.withColumn("similarity", _scored_once(_best_of(matrix))(F.col(vector)))


def match_keywords(
    vectors: DataFrame,
    keywords: DataFrame,
    threshold: float,
    *,
    vector: str = "embedding",
    keyword: str = "keyword",
    keyword_vector: str = "embedding",
) -> DataFrame:
    """``vectors`` with ``matches``: keywords at or above the threshold, best first.

    Equal similarities are ordered by keyword.
    """
    names, matrix = _keyword_rows(keywords, keyword, keyword_vector)
    pairs = _scored_once(_at_least(matrix, names, threshold))(F.col(vector))
    ordered = F.array_sort(
        F.transform(
            pairs,
            lambda p: F.struct((-p["similarity"]).alias("below"), p["keyword"].alias("keyword")),
        )
    )
    return vectors.withColumn("matches", F.transform(ordered, lambda p: p["keyword"]))


def with_text(articles: DataFrame) -> DataFrame:
    """Articles whose title and summary are not both blank."""

    def filled(column: str) -> Column:
        return F.coalesce(F.length(stripped(F.col(column))) > 0, F.lit(False))

    return articles.filter(filled("title") | filled("summary"))


def semantic_filter(
    articles: DataFrame,
    vectors: DataFrame | None,
    keywords: DataFrame,
    threshold: float = 0.5,
    *,
    article_id: str = "article_id",
    **columns: str,
) -> DataFrame:
    """Articles whose best similarity reaches the threshold, with ``similarity`` and ``score``.

    Articles that carry their vector (``vectors`` is None) are cut in one scan without a shuffle.
    Vectors of a table of their own are scored and cut before they meet the articles, so only the
    ids that were kept take part in the join; bucket large tables by id to spare its shuffle.
    """
    texts = with_text(articles.drop("similarity", "score"))
    reaches = F.col("similarity") >= threshold
    score = percent_text(F.col("similarity")).alias("score")
    if vectors is None:
        return score_vectors(texts, keywords, **columns).filter(reaches).select("*", score)
    kept = score_vectors(vectors, keywords, **columns).filter(reaches)
    return texts.join(kept.select(article_id, "similarity", score), article_id)


def scoring_account(
    articles: DataFrame,
    vectors: DataFrame,
    keywords: DataFrame,
    threshold: float = 0.5,
    *,
    article_id: str = "article_id",
    **columns: str,
) -> DataFrame:
    """``outcome, articles``: every article as kept, below the threshold, unscored, or blank.

    Unscored articles have no vector, or one that cannot be compared.
    """
    texts = with_text(articles).select(article_id).withColumn("_filled", F.lit(True))
    scored = score_vectors(vectors, keywords, **columns).select(article_id, "similarity")
    rows = articles.select(article_id).join(texts, article_id, "left").join(scored, article_id, "left")
    outcome = (
        F.when(F.col("_filled").isNull(), "blank")
        .when(F.col("similarity").isNull(), "unscored")
        .when(F.col("similarity") >= threshold, "kept")
        .otherwise("below")
    )
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("articles"))


def embed_articles(
    articles: DataFrame,
    embed: Callable[[list[str]], np.ndarray],
    out: str = "embedding",
) -> DataFrame:
    """Articles with the vector of title and summary, from a caller's batch function.

    ``embed`` maps a list of texts to a two-dimensional array. Blank articles are dropped first.
    """

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(np.asarray(embed(texts.tolist()), dtype=np.float32)))

    text = stripped(F.concat_ws(" ", "title", "summary"))
    return with_text(articles).withColumn(out, _scored_once(vectors)(text))
