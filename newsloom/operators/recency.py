"""Recency cut, per-source cap, union of sources, repeats by link."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.positions import first_per_group
from newsloom.schemas import SOURCE_KINDS, source_ordinal


def recent(
    articles: DataFrame,
    as_of: dt.datetime | Column,
    max_days: int = 10,
    *,
    include_cutoff: bool | Column,
    published: str = "published_ts",
) -> DataFrame:
    """Articles of the last ``max_days`` before ``as_of``; unknown dates are dropped.

    Feeds count the cutoff itself as recent, posts do not; a condition column tells them apart in a
    mixed table, in one scan.
    """
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of)
    cutoff = moment - F.make_interval(days=F.lit(max_days))
    column = F.col(published)
    if isinstance(include_cutoff, bool):
        return articles.filter(column >= cutoff if include_cutoff else column > cutoff)
    return articles.filter((column > cutoff) | ((column == cutoff) & include_cutoff))


def newest_per_source(
    articles: DataFrame,
    limit: int = 10,
    source: str = "source_name",
    published: str = "published_ts",
    tie: str = "article_id",
) -> DataFrame:
    """The ``limit`` newest articles of each source; no task gathers a source, whatever the limit."""
    order = [F.desc(published), F.asc(tie)]
    return first_per_group(articles, [source], order, limit, out="_newest").drop("_newest")


def union_sources(by_kind: Mapping[str, DataFrame]) -> DataFrame:
    """All articles of the given kinds in selection order; fields a kind lacks are null."""
    unknown = set(by_kind) - set(SOURCE_KINDS)
    if unknown:
        raise ValueError(f"unknown source kinds: {sorted(unknown)}")
    frames = [by_kind[kind] for kind in SOURCE_KINDS if kind in by_kind]
    if not frames:
        raise ValueError("no source is active")
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged.withColumn("source_ord", source_ordinal(F.col("source")))


def first_per_link(articles: DataFrame, link: str = "link", order: str = "seq") -> DataFrame:
    """First article of each link in input order; articles without a link are dropped."""
    first = Window.partitionBy(link).orderBy(order)
    linked = articles.filter(F.length(link) > 0)
    ranked = linked.withColumn("_copy", F.row_number().over(first))
    return ranked.filter(F.col("_copy") == 1).drop("_copy")


def counts_by_source(articles: DataFrame) -> DataFrame:
    return articles.groupBy("source").agg(F.count("*").alias("articles"))


def stage_counts(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Number of articles at each named stage, one row per stage."""
    rows = [
        frame.agg(F.count("*").alias("articles")).select(F.lit(name).alias("stage"), "articles")
        for name, frame in stages.items()
    ]
    counts = rows[0]
    for row in rows[1:]:
        counts = counts.unionByName(row)
    return counts
