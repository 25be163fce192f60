"""Incremental run: new landed files are normalised and their unseen articles appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from newsloom.operators.store import append_articles
from newsloom.sources.landing import (
    BROKEN,
    FORUM_POST,
    MICROBLOG_POST,
    forum_articles,
    microblog_articles,
    readable,
)

_JSON_KINDS = {
    "reddit": (FORUM_POST, forum_articles),
    "bluesky": (MICROBLOG_POST, microblog_articles),
}


def landed_articles(spark: SparkSession, kind: str, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of articles from the JSON files that land in a folder."""
    schema, normalise = _JSON_KINDS[kind]
    posts = (
        spark.readStream.schema(schema)
        .option("columnNameOfCorruptRecord", BROKEN)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(folder)
    )
    return normalise(readable(posts))


def append_stream(
    articles: DataFrame, store: str, checkpoint: str, rejected: str | None = None
) -> StreamingQuery:
    """Append the unseen articles of every micro-batch to the store, then stop when all is read.

    A batch that is replayed after a failure adds nothing, since its articles are stored already.
    Invalid articles go with their reason to the table at ``rejected``.
    """

    def append(batch: DataFrame, _: int) -> None:
        append_articles(batch, store, order="published", strict=False, rejected=rejected)

    return (
        articles.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
