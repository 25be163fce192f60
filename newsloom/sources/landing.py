"""Landed feed, forum and microblog files as articles.

``read_*`` functions open files; ``*_articles`` functions normalise rows of the same shape and also
serve streams. A broken record stays in the frame with its text, see ``readable`` and ``broken_counts``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.html import html_text
from newsloom.functions.posts import microblog_body, post_link, thread_body
from newsloom.functions.text import epoch_text, iso_text, shorten, utc_time, wall_clock
from newsloom.sources.subscriptions import register_reader

BROKEN = "_broken"

# Texts for missing parts of a feed entry, and the score before any scoring.
NO_TITLE, NO_SUMMARY, NO_LINK, UNSCORED = "Sans titre", "Pas de résumé", "#", "0 %"

RSS_ITEM = (
    "title string, link string, pubDate string, `dc:date` string, description string, "
    f"`content:encoded` string, {BROKEN} string"
)
ATOM_ENTRY = (
    "title string, link array<struct<_href: string, _rel: string>>, published string, "
    f"updated string, summary string, content array<string>, {BROKEN} string"
)
FORUM_POST = (
    "subreddit string, title string, selftext string, created_utc double, permalink string, "
    "score bigint, num_comments bigint, comments array<struct<body: string, score: bigint>>, "
    f"{BROKEN} string"
)
MICROBLOG_POST = (
    "uri string, author struct<handle: string, display_name: string>, "
    "record struct<text: string, created_at: string, reply: struct<parent: string>, "
    "embed: struct<type: string, external: struct<title: string, description: string>, "
    "images: array<struct<alt: string>>>>, "
    f"like_count bigint, repost_count bigint, reply_count bigint, {BROKEN} string"
)


def feed_time(text: Column) -> Column:
    """Timestamp of a feed date, mail style or ISO; null when it cannot be read.

    The name of the week day is dropped, it adds nothing and the parser refuses it.
    """
    bare = F.trim(F.regexp_replace(text, r"^\s*[A-Za-z]+,\s*", ""))
    mail = [
        F.try_to_timestamp(bare, F.lit(f"d MMM yyyy {time} {zone}"))
        for time in ("HH:mm:ss", "HH:mm")
        for zone in ("z", "XX")
    ]
    to_the_minute = F.try_to_timestamp(bare, F.lit("yyyy-MM-dd'T'HH:mmXXX"))
    return F.coalesce(*mail, bare.try_cast("timestamp"), to_the_minute)


def _page_link(links: Column) -> Column:
    """Address of an entry's page: the first link without relation or ``alternate``, else the first."""
    pages = F.filter(links, lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
    return F.coalesce(F.get(pages, F.lit(0)), F.get(links, F.lit(0)))["_href"]


def feed_entries(items: DataFrame | None, entries: DataFrame | None) -> DataFrame:
    """Items of one feed format and entries of the other in a common shape."""
    frames = []
    if items is not None:
        frames.append(
            items.select(
                "title",
                "link",
                F.col("pubDate").alias("published"),
                F.col("`dc:date`").alias("updated"),
                F.col("description").alias("summary"),
                F.col("`content:encoded`").alias("content"),
                BROKEN,
            )
        )
    if entries is not None:
        frames.append(
            entries.select(
                "title",
                _page_link(F.col("link")).alias("link"),
                "published",
                "updated",
                "summary",
                F.get("content", F.lit(0)).alias("content"),
                BROKEN,
            )
        )
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged


def feed_articles(entries: DataFrame) -> DataFrame:
    """Articles of feed entries: published else updated date, content else summary, plain text."""
    published = F.coalesce(feed_time(F.col("published")), feed_time(F.col("updated")))
    body = F.coalesce("content", "summary", F.lit(NO_SUMMARY))
    return entries.select(
        F.coalesce("title", F.lit(NO_TITLE)).alias("title"),
        html_text(body).alias("summary"),
        F.coalesce("link", F.lit(NO_LINK)).alias("link"),
        published.alias("published_ts"),
        iso_text(utc_time(published)).alias("published"),
        F.lit(UNSCORED).alias("score"),
        F.lit("rss").alias("source"),
    )


def forum_articles(posts: DataFrame) -> DataFrame:
    """Articles of forum posts: title, text and best comments as body, votes as first score."""
    published = F.timestamp_seconds("created_utc")
    return posts.select(
        "title",
        thread_body(F.col("title"), F.col("selftext"), F.col("comments")).alias("summary"),
        F.concat(F.lit("https://reddit.com"), "permalink").alias("link"),
        published.alias("published_ts"),
        epoch_text(F.col("created_utc")).alias("published"),
        F.col("score").cast("string").alias("score"),
        F.lit("reddit").alias("source"),
        F.lit("reddit").alias("source_type"),
        F.concat(F.lit("r/"), "subreddit").alias("source_name"),
        "num_comments",
    )


def microblog_articles(posts: DataFrame) -> DataFrame:
    """Articles of microblog posts; the first characters of the body serve as title."""
    record, author = F.col("record"), F.col("author")
    body = microblog_body(record["text"], record["embed"], record["reply"]["parent"])
    handle = F.nullif(author["handle"], F.lit(""))
    display = F.nullif(author["display_name"], F.lit(""))
    published = wall_clock(record["created_at"])
    with_body = posts.select(
        body.alias("summary"),
        post_link(F.col("uri"), author["handle"]).alias("link"),
        published.alias("published_ts"),
        iso_text(published).alias("published"),
        F.lit(UNSCORED).alias("score"),
        F.lit("bluesky").alias("source"),
        F.lit("bluesky").alias("source_type"),
        F.concat(F.lit("@"), F.coalesce(handle, F.lit("unknown"))).alias("source_name"),
        F.coalesce(display, handle, F.lit("Unknown")).alias("author"),
        F.coalesce("like_count", F.lit(0)).alias("likes"),
        F.coalesce("repost_count", F.lit(0)).alias("reposts"),
        F.coalesce("reply_count", F.lit(0)).alias("replies"),
    )
    return with_body.withColumn("title", shorten(F.col("summary"), 100))


def readable(records: DataFrame, watch: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Records that could be read; ``watch`` sees how many were and how many are broken."""
    whole = F.col(BROKEN).isNull()
    if watch:
        records = watch(records, read=whole, broken=~whole)
    return records.filter(whole)


def broken_counts(records: DataFrame) -> DataFrame:
    """Broken records per file, and how many of them still gave some field."""
    fields = [F.col(f"`{c}`").cast("string") for c in records.columns if c != BROKEN]
    broken = F.col(BROKEN).isNotNull()
    filed = records.select("*", F.col("_metadata.file_path").alias("file"))
    counts = filed.groupBy("file").agg(
        F.count_if(broken).alias("broken"),
        F.count_if(broken & F.coalesce(*fields).isNotNull()).alias("partly_read"),
    )
    return counts.filter(F.col("broken") > 0)


def _xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return (
        spark.read.format("xml")
        .schema(schema)
        .option("rowTag", row_tag)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BROKEN)
        .load(path)
    )


def read_feed_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of landed feed files, both formats."""
    return feed_entries(
        _xml(spark, path, "item", RSS_ITEM), _xml(spark, path, "entry", ATOM_ENTRY)
    )


def read_forum_posts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FORUM_POST).json(path, columnNameOfCorruptRecord=BROKEN)


def read_microblog_posts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MICROBLOG_POST).json(path, columnNameOfCorruptRecord=BROKEN)


def _feeds(spark: SparkSession, path: str, watch: Callable[..., DataFrame] | None = None) -> DataFrame:
    return feed_articles(readable(read_feed_entries(spark, path), watch))


def _forums(spark: SparkSession, path: str, watch: Callable[..., DataFrame] | None = None) -> DataFrame:
    return forum_articles(readable(read_forum_posts(spark, path), watch))


def _microblogs(spark: SparkSession, path: str, watch: Callable[..., DataFrame] | None = None) -> DataFrame:
    return microblog_articles(readable(read_microblog_posts(spark, path), watch))


register_reader("rss", _feeds)
register_reader("reddit", _forums)
register_reader("bluesky", _microblogs)
