"""Digest of chosen articles as rows of text, one row per line block."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.html import escaped
from newsloom.functions.text import iso_to_day, line_breaks, local_datetime, whole_percent


def _check(threshold: float) -> None:
    if not 0 <= threshold <= 1:
        raise ValueError(f"threshold must lie in [0, 1]: {threshold}")


def _heading(title: str, count: Column, keywords: Sequence[str], threshold: float, day: Column) -> Column:
    return F.concat(
        F.lit(f"{title} - Résumé du "),
        day,
        F.lit("\n\nLes "),
        count.cast("string"),
        F.lit(" derniers articles filtrés et résumés.\nMots clés : "),
        F.lit(", ".join(keywords)),
        F.lit(" sur un seuil >= "),
        whole_percent(F.lit(float(threshold))),
    )


def _entry() -> Column:
    """Text block of one article; missing fields show as nothing."""

    def field(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return F.concat(
        F.lit("Titre: "), field("title"),
        F.lit("\nLien: "), field("link"),
        F.lit("\n"), field("summary"),
        F.lit("\n---"),
    )


def digest_lines(
    articles: DataFrame,
    keywords: Sequence[str],
    threshold: float = 0.5,
    *,
    title: str = "Revue de presse",
    order: str = "position",
    day: str | dt.date | None = None,
    day_column: str | None = None,
) -> DataFrame:
    """Text digest as rows ``digest_day, ord, line``: one heading per day, one row per article.

    Pass ``day`` for one digest of all rows, or ``day_column`` for a digest per day. Lines stay
    rows, so a day of any size is never gathered into one text.
    """
    _check(threshold)
    if day_column:
        day_text = F.col(day_column)
    else:
        date = dt.date.fromisoformat(day) if isinstance(day, str) else day or dt.date.today()
        day_text = F.lit(date.strftime("%d/%m/%Y"))
    dated = articles.withColumn("digest_day", day_text)
    entries = dated.select("digest_day", F.col(order).cast("bigint").alias("ord"), _entry().alias("line"))
    if day_column:
        counts = dated.groupBy("digest_day").agg(F.count("*").alias("_count"))
    else:
        # A digest of no articles still has its heading.
        counts = dated.agg(F.count("*").alias("_count")).withColumn("digest_day", day_text)
    headings = counts.select(
        "digest_day",
        F.lit(-1).cast("bigint").alias("ord"),
        _heading(title, F.col("_count"), keywords, threshold, F.col("digest_day")).alias("line"),
    )
    return headings.unionByName(entries)


def html_entries(articles: DataFrame, *, order: str = "position") -> DataFrame:
    """HTML block per article: linked title with score, both dates, body with line breaks."""
    return articles.select(F.col(order).cast("bigint").alias("ord"), _html_block().alias("block"))


def _html_block() -> Column:
    def field(name: str) -> Column:
        return escaped(F.coalesce(F.col(name).cast("string"), F.lit("")))

    return F.concat(
        F.lit('<h3><a href="'), field("link"), F.lit('">'), field("title"), F.lit("</a> - "),
        field("score"), F.lit(" %</h3>\n<h4><small>publié le "),
        F.coalesce(iso_to_day(F.col("published")), F.lit("")),
        F.lit(" - résumé du "), local_datetime(F.col("dt_created")),
        F.lit("</small></h4>\n<p>"), line_breaks(escaped(F.col("summary"))), F.lit("</p>"),
    )


def html_page(
    articles: DataFrame,
    keywords: Sequence[str],
    threshold: float = 0.5,
    *,
    title: str = "Revue de presse",
    order: str = "position",
    day_column: str = "day",
) -> DataFrame:
    """HTML digest as rows ``digest_day, ord, block``: a heading per day (-1), then a block per article.

    The heading names the day, the number of articles, the keywords and the threshold. Scores are texts
    with or without a percent sign.
    """
    _check(threshold)
    bare = F.trim(F.regexp_replace(F.col("score").cast("string"), r"\s*%\s*$", ""))
    dated = articles.withColumns({"digest_day": F.col(day_column), "score": bare})
    counts = dated.groupBy("digest_day").agg(F.count("*").alias("_count"))
    heading = F.concat(
        F.lit("<h1>"), escaped(F.lit(title)), F.lit(" - Résumé du "), F.col("digest_day"), F.lit("</h1>\n<p>Les "),
        F.col("_count").cast("string"), F.lit(" derniers articles filtrés et résumés.</p>\n<p>Mots clés : "),
        escaped(F.lit(", ".join(keywords))), F.lit(" sur un seuil &gt;= "), whole_percent(F.lit(float(threshold))),
        F.lit("</p>"),
    )
    heads = counts.select("digest_day", F.lit(-1).cast("bigint").alias("ord"), heading.alias("block"))
    return heads.unionByName(
        dated.select("digest_day", F.col(order).cast("bigint").alias("ord"), _html_block().alias("block"))
    )


def write_digest(lines: DataFrame, path: str) -> None:
    """Land digest rows as a table, a folder per day.

    The rows of a day meet first, so a day has one file however its rows came; Spark splits a day that is too large
    for a task.
    """
    lines.hint("rebalance", "digest_day").write.mode("append").partitionBy("digest_day").parquet(path)
