"""Schemas and fixed vocabularies shared by readers and operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The source kinds, in selection order.
SOURCE_KINDS = ("rss", "reddit", "bluesky")

# Fields every article carries; a stored article must have all of them.
REQUIRED_FIELDS = ("title", "link", "summary", "score", "published", "source")

# Partition column of the stored table: the first ten characters of the publication text.
DAY = "published_day"

SOURCES_SCHEMA = (
    "type string, url string, link string, name string, "
    "subreddit string, sort_by string, time_filter string"
)

STORED_ARTICLE_SCHEMA = (
    "article_id bigint, dt_created timestamp, dt_updated timestamp, title string, link string, "
    "summary string, score string, published string, source string"
)

METRIC_LOG_SCHEMA = (
    "type string, metric string, "
    "data struct<time: string, value: double, tags: struct<scenario: string>>"
)


def source_ordinal(source: Column) -> Column:
    """Position of a source kind in the selection order; null for an unknown kind."""
    ordinal = F.when(source == SOURCE_KINDS[0], F.lit(0))
    for position, kind in enumerate(SOURCE_KINDS[1:], start=1):
        ordinal = ordinal.when(source == kind, F.lit(position))
    return ordinal
