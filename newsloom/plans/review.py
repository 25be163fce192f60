"""The composed review: recent articles, scored, chosen, summarised, appended, digested."""

from __future__ import annotations

import datetime as dt
import inspect
from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.positions import number_rows
from newsloom.operators.recency import newest_per_source, recent, union_sources
from newsloom.operators.reports import RunReport
from newsloom.operators.selection import Balance, select_articles
from newsloom.operators.similarity import semantic_filter
from newsloom.operators.summaries import summarise
from newsloom.plans.staging import staged
from newsloom.sources import landing  # noqa: F401  (registers the readers)
from newsloom.sources.subscriptions import active_kinds, reader_of


def fetch(
    spark: SparkSession,
    folders: Mapping[str, str],
    as_of: dt.datetime,
    max_days: int = 10,
    per_source: int = 10,
    settings: Mapping[str, str] | None = None,
    report: RunReport | None = None,
) -> DataFrame:
    """Recent articles of all active kinds from their landing folders, in selection order.

    Broken records are left out; a ``report`` counts, by kind, the records that were ``read`` or ``broken``, the
    ``newest`` of each source and the ``recent`` ones, in the job that writes the articles. A registered reader may
    take a ``watch`` argument to have its records counted.

    Posts are capped per source and then cut by date; feeds are only cut by date. ``article_id`` is a hash of
    source, link, title and date, so that it stays the same from run to run; ``seq`` numbers the articles,
    newest first, equal dates by link and title. The articles are staged, so that all that follows sees the same rows.
    """
    frames = {}
    for kind in active_kinds(settings or {}):
        if kind not in folders:
            continue
        reader = reader_of(kind)
        watched = {}
        if report and "watch" in inspect.signature(reader).parameters:
            watched["watch"] = partial(report.watch_kind, kind=kind)
        articles = reader(spark, folders[kind], **watched)
        if kind != "rss":
            articles = newest_per_source(articles, per_source, tie="link")
            if report:
                articles = report.watch_kind(articles, kind, newest=F.lit(True))
        frames[kind] = recent(articles, as_of, max_days, include_cutoff=kind == "rss")
    found = union_sources(frames)
    if report:
        found = report.watch(found, "recent")
    # The files are read once: the order that follows reads its rows twice.
    found = staged(found.withColumn("article_id", F.xxhash64("source", "link", "title", "published")))
    return number_rows(found, [F.desc("published_ts"), "link", "title", "article_id"], out="seq")


def review(
    articles: DataFrame,
    vectors: DataFrame | None,
    keywords: DataFrame,
    *,
    threshold: float = 0.5,
    balance: Balance | None = None,
    answer: Callable[[list[str]], list[str]],
    limit: int = -1,
    columns: Mapping[str, str] | None = None,
) -> DataFrame:
    """Chosen and summarised articles of a candidate set, by ``position``.

    Candidates carry their vector, or it is found in ``vectors``; then only the vectors of
    candidates are scored, since the ids alone meet the vectors first.
    """
    if vectors is not None:
        vectors = vectors.join(articles.select("article_id"), "article_id", "left_semi")
    kept = semantic_filter(articles, vectors, keywords, threshold, **(columns or {}))
    chosen = select_articles(kept, balance)
    return summarise(chosen, answer, limit=limit)


def recent_of_all(articles: DataFrame, as_of: dt.datetime | Column, max_days: int = 10) -> DataFrame:
    """Recency cut of a mixed table: feeds keep the cutoff itself, posts do not."""
    return recent(articles, as_of, max_days, include_cutoff=F.col("source") == "rss")


def keyword_list(text: str, default: Sequence[str] = ()) -> list[str]:
    """Keywords of a comma-separated setting; the default when it is empty."""
    words = [word for word in text.split(",") if word]
    return words or list(default)
