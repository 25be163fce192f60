"""The stored article table: validation, append of unseen articles, listing."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import iso_to_day
from newsloom.operators.positions import number_rows
from newsloom.plans.staging import staged
from newsloom.schemas import DAY, REQUIRED_FIELDS, SOURCE_KINDS, STORED_ARTICLE_SCHEMA

KEY = ["title", "published"]

# Parts into which the rows of one key are split when a batch meets the stored keys.
KEY_COPIES = 16


def with_default_source(articles: DataFrame, default: str = "rss") -> DataFrame:
    return articles.withColumn("source", F.coalesce("source", F.lit(default)))


def validated(articles: DataFrame) -> DataFrame:
    """Articles with ``reject_reason``, null for a valid one; the first fault is named."""
    reason = F.lit(None).cast("string")
    unknown = ~F.col("source").isin(*SOURCE_KINDS)
    reason = F.when(unknown, F.lit("unknown source")).otherwise(reason)
    for field in reversed(REQUIRED_FIELDS):
        reason = F.when(F.col(field).isNull(), F.lit(f"missing {field}")).otherwise(reason)
    return articles.withColumn("reject_reason", reason)


def split_valid(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid articles, and the rejected ones with their reason."""
    checked = validated(articles)
    good = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return good, checked.filter(F.col("reject_reason").isNotNull())


def unseen(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Articles of a batch whose title and publication are not stored yet.

    Repeats inside the batch are all kept. Only stored keys in the batch's publication range can
    match; the range is a subquery that reaches the scan of the stored table. Keys of both sides
    collapse in every task before they meet. The rows of the batch then meet only the keys that were
    found, spread over a few copies of them, so that a key with many rows is not gathered.
    """
    span = batch.agg(F.min("published").alias("low"), F.max("published").alias("high"))
    published = F.col("published")
    near = stored.filter(
        (published >= span.select("low").scalar()) & (published <= span.select("high").scalar())
    )
    if DAY in stored.columns:
        day = F.col(DAY)
        near = near.filter(
            (day >= span.select(_day_of(F.col("low"))).scalar())
            & (day <= span.select(_day_of(F.col("high"))).scalar())
        )
    # An inner join: a semi join would be moved below the first distinct.
    found = batch.select(*KEY).distinct().join(near.select(*KEY).distinct(), KEY)
    copies = found.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(KEY_COPIES - 1))))
    row = F.xxhash64(*[c for c in batch.columns if c != "summary"])
    spread = batch.withColumn("_copy", F.pmod(row, F.lit(KEY_COPIES)).cast("int"))
    return spread.join(copies, [*KEY, "_copy"], "left_anti").select(*batch.columns)


def _day_of(published: Column) -> Column:
    return F.substring(published, 1, 10)


def stamp_new(articles: DataFrame, at: dt.datetime | Column | None = None) -> DataFrame:
    """Creation and update time of inserted rows, the same for the whole batch."""
    moment = _moment(at)
    return articles.withColumns({"dt_created": moment, "dt_updated": moment})


def stamp_changed(articles: DataFrame, at: dt.datetime | Column | None = None) -> DataFrame:
    """Update time of changed rows; the creation time stays."""
    return articles.withColumn("dt_updated", _moment(at))


def _moment(at: dt.datetime | Column | None) -> Column:
    if at is None:
        return F.current_timestamp()
    return at if isinstance(at, Column) else F.lit(at)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Stored articles; an empty table when nothing was stored yet."""
    schema = f"{STORED_ARTICLE_SCHEMA}, {DAY} string"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_articles(
    batch: DataFrame,
    path: str,
    *,
    order: str = "seq",
    at: dt.datetime | None = None,
    strict: bool = True,
    rejected: str | None = None,
) -> int:
    """Append the unseen articles of a batch to the table at ``path``; returns how many.

    With ``strict`` one invalid article fails the whole batch before anything is written, else the
    invalid ones are left out, and appended with their reason to the table at ``rejected`` if given
    (a batch that is repeated reports them again). New ids continue the stored ones in batch order. Texts are staged
    once with the batch and written once. The write is one job; a batch that is repeated after a
    failure adds only what is missing.
    """
    stored = read_store(batch.sparkSession, path)
    # A batch may come from a model: it is computed once. All that follows is done on its short columns.
    batch = staged(
        batch.select(*REQUIRED_FIELDS, F.col(order).alias("_order"), F.monotonically_increasing_id().alias("_row"))
    )
    short = validated(batch).select(*KEY, "link", "_order", "_row", "reject_reason")
    new = staged(unseen(short, stored))
    outcomes = {r.reject_reason: r["count"] for r in new.groupBy("reject_reason").count().collect()}
    appended = outcomes.pop(None, 0)
    if outcomes and strict:
        raise ValueError(f"invalid articles: {outcomes}")
    if outcomes and rejected:
        reasons = new.filter(F.col("reject_reason").isNotNull()).select("_row", "reject_reason")
        faulty = batch.join(reasons, "_row").select(*REQUIRED_FIELDS, "reject_reason")
        faulty.write.mode("append").parquet(rejected)
    if not appended:
        return 0
    last = _last_id(stored, path)
    valid = new.filter(F.col("reject_reason").isNull())
    numbered = number_rows(valid.drop("reject_reason"), ["_order", "published", "title", "link"])
    chosen = batch.join(numbered.select("_row", "position"), "_row")
    rows = stamp_new(chosen, at).select(
        (F.lit(last) + F.col("position")).cast("bigint").alias("article_id"),
        "dt_created",
        "dt_updated",
        *REQUIRED_FIELDS,
        _day_of(F.col("published")).alias(DAY),
    )
    # Ids are taken before they are used: after a failure some stay unused, none is given twice.
    taken = batch.sparkSession.createDataFrame([(last + appended,)], "article_id bigint")
    taken.coalesce(1).write.mode("append").parquet(_ids_path(path))
    # Few files per day, and several for a day that holds much of the batch.
    rows.hint("rebalance", DAY).write.mode("append").partitionBy(DAY).parquet(path)
    return appended


def _ids_path(path: str) -> str:
    return f"{path.rstrip('/')}-ids"


def _last_id(stored: DataFrame, path: str) -> int:
    """Greatest id given so far; only a store without the small table beside it is read for it."""
    try:
        ids = stored.sparkSession.read.schema("article_id bigint").parquet(_ids_path(path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        ids = stored
    return ids.agg(F.coalesce(F.max("article_id"), F.lit(0)).alias("last")).first().last


@dataclass(frozen=True)
class Change:
    """What a change did: the old rows of updated and deleted articles, and the new rows of updated ones."""

    removed: DataFrame
    added: DataFrame
    days: tuple[str, ...]


def change_articles(
    spark: SparkSession,
    path: str,
    *,
    updates: DataFrame | None = None,
    deletes: DataFrame | None = None,
    at: dt.datetime | None = None,
) -> Change:
    """Update and delete stored articles by id, rewriting only the days that hold them.

    ``updates`` has ``article_id`` and the fields that change, any of those an article must have; other
    fields and the creation time stay, the update time is new. ``deletes`` has ``article_id``. Ids that are not
    stored, or null, change nothing; an id in both is deleted. An id that is updated twice, or a new state
    that is not valid, is an error before anything is written. An article whose publication moves goes to its new
    day. The result serves ``segments.change_index``.
    """
    stored = read_store(spark, path)
    nothing = spark.createDataFrame([], "article_id bigint")
    updates = staged(nothing if updates is None else updates.filter("article_id IS NOT NULL"))
    deletes = staged((nothing if deletes is None else deletes).select("article_id").distinct())
    twice = updates.groupBy("article_id").agg(F.count("*").alias("many")).filter("many > 1").limit(5).collect()
    if twice:
        raise ValueError(f"updated more than once: {sorted(row[0] for row in twice)}")
    ids = staged(updates.select("article_id").union(deletes).distinct())
    # Days come from the ids alone; whole rows are read of these days.
    days = {row[0] for row in stored.select("article_id", DAY).join(ids, "article_id").select(DAY).distinct().collect()}
    if not days:
        return Change(stored.limit(0), stored.limit(0), ())
    removed = staged(stored.filter(F.col(DAY).isin(*days)).join(ids, "article_id"))
    changed = [field for field in REQUIRED_FIELDS if field in updates.columns]
    new = updates.select(F.col("article_id"), *[F.col(field).alias(f"_new_{field}") for field in changed])
    added = removed.join(new, "article_id").join(deletes, "article_id", "left_anti")
    added = added.withColumns({field: F.col(f"_new_{field}") for field in changed})
    added = stamp_changed(added, at).withColumn(DAY, _day_of(F.col("published"))).select(*stored.columns)
    added = staged(added)
    faults = validated(added).filter("reject_reason IS NOT NULL").groupBy("reject_reason").count().collect()
    if faults:
        raise ValueError(f"invalid articles: {({row.reject_reason: row['count'] for row in faults})}")
    days |= {row[0] for row in added.select(DAY).distinct().collect()}
    touched = stored.filter(F.col(DAY).isin(*days))
    rows = staged(touched.join(ids, "article_id", "left_anti").select(*stored.columns).union(added))
    emptied = sorted(days - {row[0] for row in rows.select(DAY).distinct().collect()})
    odd = [day for day in emptied if not re.fullmatch(r"[\w.-]+", day)]
    if odd:
        raise ValueError(f"no days of publication: {odd}")
    writer = rows.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(DAY).parquet(path)
    for day in emptied:
        rows.limit(0).drop(DAY).coalesce(1).write.mode("overwrite").parquet(f"{path}/{DAY}={day}")
    return Change(removed, added, tuple(sorted(days)))


def newest_first(articles: DataFrame, limit: int | None = None) -> DataFrame:
    """All articles, newest first; equal dates by id."""
    ordered = articles.orderBy(F.desc("published"), F.asc("article_id"))
    return ordered if limit is None else ordered.limit(limit)


def on_date(articles: DataFrame, date: str) -> DataFrame:
    """Articles whose publication text contains the date text, in no order.

    A whole date reads a single day of a stored table.
    """
    found = F.contains("published", F.lit(date))
    if DAY in articles.columns and re.fullmatch(r"\d{4}-\d{2}-\d{2}", date):
        found &= F.col(DAY) == date
    return articles.filter(found)


def table_of_contents(articles: DataFrame) -> DataFrame:
    """Running number, title and day of every listed article, newest first."""
    listed = articles.select("article_id", "title", "published")
    numbered = number_rows(listed, [F.desc("published"), F.asc("article_id")], out="number")
    return numbered.select(
        "number",
        "article_id",
        F.concat("title", F.lit(" ("), iso_to_day(F.col("published")), F.lit(")")).alias("entry"),
    )
