"""A stored word index of the articles, and hits read from it.

The index is one table with a row per token: ``term``, ``article_id``, ``col``, ``pos`` and the
article's length ``doc_len``. The empty term stands once for every article, also for one without any
token, so that the size and mean length of the corpus are read like any term. Rows are range-sorted
by term and article: a query reads only the row groups of its terms, and a very common term is spread
over many files.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.search import (
    ID_COLUMN,
    TEXT_COLUMNS,
    Query,
    _with_words,
    _word_test,
    mark_hits,
    scored_hits,
    shaped,
    top_ranked,
)

# The term that stands for the article itself.
WHOLE = ""


def _split(articles: DataFrame, index_id: bool) -> tuple[DataFrame, dict[str, str]]:
    columns = articles.select(ID_COLUMN, *TEXT_COLUMNS.values())
    split, fields = _with_words(columns, index_id)
    length = reduce(lambda a, b: a + b, [F.size(array) for array in fields.values()])
    return split.select(ID_COLUMN, *fields.values(), length.alias("doc_len")), fields


def build_index(articles: DataFrame, *, index_id: bool = False) -> DataFrame:
    """Index rows of the articles; a narrow explode without a shuffle.

    With ``index_id`` the article id is a word of the article.
    """
    split, fields = _split(articles, index_id)
    per_field = [F.struct(F.lit(name).alias("col"), F.col(c).alias("words")) for name, c in fields.items()]
    itself = F.struct(F.lit("").alias("col"), F.array(F.lit(WHOLE)).alias("words"))
    by_field = split.select(ID_COLUMN, "doc_len", F.inline(F.array(itself, *per_field)))
    return by_field.select(
        F.posexplode("words").alias("pos", "term"), ID_COLUMN, "col", "doc_len"
    ).select("term", ID_COLUMN, "col", "pos", "doc_len")


def write_index(articles: DataFrame, path: str, *, index_id: bool = False, mode: str = "overwrite") -> None:
    """Write the index; ``mode='append'`` adds the rows of new articles.

    Ids that the index holds already are refused: their rows would count twice.
    """
    order = ["term", ID_COLUMN, "col", "pos"]
    if mode == "append":
        held = articles.sparkSession.read.parquet(path).filter(F.col("term") == WHOLE).select(ID_COLUMN)
        known = held.join(articles.select(ID_COLUMN), ID_COLUMN, "left_semi").limit(5).collect()
        if known:
            raise ValueError(f"already in the index: {sorted(row[0] for row in known)}")
    rows = build_index(articles, index_id=index_id)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).parquet(path)


def refresh_index(
    index: DataFrame, changed: DataFrame, upserts: DataFrame, *, index_id: bool = False
) -> DataFrame:
    """Index after a change set.

    ``changed`` holds the ids of inserted, updated and deleted articles; ``upserts`` the new state
    of those that still exist. Articles that are only added need no refresh: append their rows.
    """
    kept = index.join(changed.select(ID_COLUMN).distinct(), ID_COLUMN, "left_anti")
    return kept.select(*index.columns).unionByName(build_index(upserts, index_id=index_id))


def term_statistics(articles: DataFrame, *, index_id: bool = False) -> DataFrame:
    """Articles that hold each term and how often it occurs, in one shuffle.

    The distinct terms of an article follow its tokens in one array, so a row's place tells which
    of the two counts it belongs to; a common term collapses in every task before it is sent.
    """
    split, fields = _split(articles, index_id)
    words = split.select(F.concat(*fields.values()).alias("_words"))
    both = words.select(
        F.size("_words").alias("_size"),
        F.posexplode(F.concat("_words", F.array_distinct("_words"))).alias("_at", "term"),
    )
    is_token = F.col("_at") < F.col("_size")
    return both.groupBy("term").agg(
        F.count_if(~is_token).alias("articles"), F.count_if(is_token).alias("occurrences")
    )


def index_hits(index: DataFrame, searched: Query) -> DataFrame:
    """Articles that hold any unit, with ``doc_len`` and occurrences ``n_0``, ``n_1``, ...

    The terms are pushed to the scan. Without a phrase the counts combine in each task before the
    shuffle; a phrase brings the query's tokens of an article together once.
    """
    term = F.col("term")
    tests = [_word_test(term, u, o) for u in searched.units for o in range(len(u.words))]
    read = index.filter((term != WHOLE) & reduce(or_, tests))
    phrases = any(len(u.words) > 1 for u in searched.units)
    if phrases:
        read = read.repartition(ID_COLUMN)
    in_text = Window.partitionBy(ID_COLUMN, "col").orderBy("pos")
    names = []
    for number, searched_unit in enumerate(searched.units):
        holds = [_word_test(term, searched_unit, 0)]
        for offset in range(1, len(searched_unit.words)):
            ahead = F.lead("term", offset).over(in_text)
            adjacent = F.lead("pos", offset).over(in_text) == F.col("pos") + offset
            holds += [_word_test(ahead, searched_unit, offset), adjacent]
        if searched_unit.column:
            holds.append(F.col("col") == searched_unit.column)
        names.append(f"n_{number}")
        read = read.withColumn(names[-1], F.coalesce(reduce(and_, holds), F.lit(False)).cast("int"))
    return read.groupBy(ID_COLUMN).agg(
        F.max("doc_len").alias("doc_len"), *[F.sum(n).alias(n) for n in names]
    )


def index_statistics(index: DataFrame, hits: DataFrame, searched: Query) -> DataFrame:
    """Corpus statistics of a query: articles per unit from the hits, the rest from the index."""
    size = index.filter(F.col("term") == WHOLE).agg(
        F.count("*").alias("docs"), (F.sum("doc_len") / F.count("*")).alias("mean_len")
    )
    held = hits.agg(
        *[F.count_if(F.col(f"n_{i}") > 0).alias(f"df_{i}") for i in range(len(searched.scored))]
    )
    return held.withColumn("_size", size.select(F.struct("docs", "mean_len")).scalar()).select(
        "_size.docs", "_size.mean_len", *held.columns
    )


def search_index(
    articles: DataFrame,
    index: DataFrame,
    searched: Query,
    *,
    date_min: str | None = None,
    date_max: str | None = None,
    inclusive_end: bool = False,
    limit: int | None = 10,
    mark: tuple[str, str] | None = ("<mark>", "</mark>"),
) -> DataFrame:
    """Ranked search through the index; same result as ``search`` on the texts.

    Article texts are read only for the ids that survive the limit.
    """
    hits = index_hits(index, searched)
    scored = scored_hits(hits, searched, index_statistics(index, hits, searched))
    found = top_ranked(
        scored, limit, date_min, date_max, inclusive_end=inclusive_end, dates=articles
    )
    ranks = found.select(ID_COLUMN, "rank", "bm25")
    found = articles.join(ranks, ID_COLUMN)
    found = found.orderBy(F.desc("bm25"), F.asc(ID_COLUMN))
    if mark:
        found = mark_hits(found, searched, *mark)
    return shaped(found)
