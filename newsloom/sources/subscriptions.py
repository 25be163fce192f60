"""Subscription lists, source switches and the registry of source kinds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.schemas import SOURCE_KINDS, SOURCES_SCHEMA

# Texts for missing names and links, and the feeds used without a readable list.
NO_TITLE, NO_LINK, DEFAULT_TITLE = "Sans titre", "Aucun lien web", "Flux par défaut"
DEFAULT_FEEDS = (
    "http://dotmobo.github.io/feeds/all.atom.xml",
    "https://cert.ssi.gouv.fr/alerte/feed/",
    "https://www.djangoproject.com/rss/community/",
)
# Texts that switch a source on.
TRUE_TEXTS = ("1", "true", "yes", "on", "oui")

_OUTLINE = r"""<outline\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""

Reader = Callable[[SparkSession, str], DataFrame]
_READERS: dict[str, Reader] = {}


def register_reader(kind: str, reader: Reader) -> None:
    """Make ``reader(spark, path)`` the reader of a source kind."""
    if kind not in SOURCE_KINDS:
        raise ValueError(f"unknown source kind: {kind}")
    _READERS[kind] = reader


def reader_of(kind: str) -> Reader:
    if kind not in _READERS:
        raise ValueError(f"no reader registered for {kind}")
    return _READERS[kind]


def active_kinds(settings: Mapping[str, str]) -> list[str]:
    """Kinds whose ``<KIND>_FETCH`` setting is on (the default); an error when none is."""
    active = [
        kind
        for kind in SOURCE_KINDS
        if settings.get(f"{kind.upper()}_FETCH", "1").lower() in TRUE_TEXTS
    ]
    if not active:
        raise ValueError("no source is active")
    return active


def only_active(articles: DataFrame, settings: Mapping[str, str]) -> DataFrame:
    return articles.filter(F.col("source").isin(*active_kinds(settings)))


def _default_feeds(spark: SparkSession) -> DataFrame:
    rows = [(at, DEFAULT_TITLE, url, NO_LINK) for at, url in enumerate(DEFAULT_FEEDS)]
    return spark.createDataFrame(rows, "seq int, title string, url string, link string")


def read_opml(spark: SparkSession, path: str) -> DataFrame:
    """Feeds of an OPML list in document order, at any outline depth.

    Only outlines of type ``rss`` count. A missing or malformed list gives the default feeds.
    """
    try:
        content = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return _default_feeds(spark)
    checked = F.from_xml(
        "value", "_broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    )
    if content.filter(checked.isNull() | checked["_broken"].isNotNull()).limit(1).count():
        return _default_feeds(spark)

    bare = F.regexp_replace("value", r"(?s)<!--.*?-->", "")
    tags = content.select(F.posexplode(F.regexp_extract_all(bare, F.lit(_OUTLINE), F.lit(0))))
    # Each outline alone, closed, is a document whose attributes can be read by name.
    closed = tags.select(
        F.col("pos").alias("seq"),
        F.concat(F.regexp_replace("col", r"/?>$", ""), F.lit("/>")).alias("outline"),
    )

    def attribute(name: str) -> Column:
        return F.nullif(F.xpath_string("outline", F.lit(f"/outline/@{name}")), F.lit(""))

    return closed.filter(F.xpath_string("outline", F.lit("/outline/@type")) == "rss").select(
        "seq",
        F.coalesce(attribute("title"), attribute("text"), F.lit(NO_TITLE)).alias("title"),
        attribute("xmlUrl").alias("url"),
        F.coalesce(attribute("htmlUrl"), F.lit(NO_LINK)).alias("link"),
    )


def feed_sources(feeds: DataFrame) -> DataFrame:
    """Feeds as source rows."""
    return feeds.select(
        F.lit("rss").alias("type"),
        "url",
        "link",
        F.col("title").alias("name"),
        F.lit(None).cast("string").alias("subreddit"),
        F.lit("hot").alias("sort_by"),
        F.lit("day").alias("time_filter"),
    )


def read_source_list(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Sources of one kind from a JSON list; entries of another kind or without address are skipped."""
    listed = spark.read.schema(f"sources array<struct<{_as_struct(SOURCES_SCHEMA)}>>").json(
        path, multiLine=True
    )
    entries = listed.select(F.inline("sources")).filter(F.col("type") == kind)
    url = F.col("url")
    if kind == "reddit":
        url = F.concat(F.lit("reddit.com/r/"), "subreddit")
    return entries.withColumns(
        {
            "url": url,
            "sort_by": F.coalesce("sort_by", F.lit("hot")),
            "time_filter": F.coalesce("time_filter", F.lit("day")),
        }
    ).filter(F.col("url").isNotNull())


def _as_struct(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.split() for f in schema.split(", ")))


def matching_keywords(
    feeds: DataFrame, keywords: Sequence[str], columns: Sequence[str] = ("title", "url")
) -> DataFrame:
    """Feeds whose title or address contains any keyword, whatever the case."""
    tests = [
        F.contains(F.lower(F.col(column)), F.lit(keyword.lower()))
        for keyword in keywords
        for column in columns
    ]
    return feeds.filter(reduce(or_, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False)))


def address_class(url: Column) -> Column:
    """Class of a microblog address; only ``user`` addresses deliver posts."""
    return (
        F.when(F.startswith(url, F.lit("firehose")), "firehose")
        .when(F.startswith(url, F.lit("@")) | F.startswith(url, F.lit("did:")), "user")
        .when(F.contains(url, F.lit("bsky.app/profile/")), "profile")
        .otherwise("unsupported")
    )
