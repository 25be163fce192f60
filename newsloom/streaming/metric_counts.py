"""Counts of a growing metric log that add up, so that percentiles need no old log file.

A batch of points becomes counts per run, metric, time step and value. Counts of batches are added, and the
exact percentiles of all points are read from the sums.

The store is a folder with one part per micro-batch, ``upto=-1/batch=<n>``, and one per merge,
``upto=<last batch>/batch=-1``. A batch that is replayed after a failure overwrites its own part. A reader
takes the newest merge and the batches after it; older parts may be removed at any time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from newsloom.operators.metrics import REPORT_SHARES, _percentiles
from newsloom.operators.positions import interpolated, value_ranks

COUNTS = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("copies", T.LongType()),
    ]
)
_PARTS = T.StructType([*COUNTS, T.StructField("upto", T.LongType()), T.StructField("batch", T.LongType())])
_OPEN = -1


def point_counts(points: DataFrame, seconds: int) -> DataFrame:
    """``run, metric, step, value, copies`` of points; ``step`` numbers the time steps since the epoch.

    Points without value are left out; those without time have no step. Equal values collapse in each task.
    """
    step = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("bigint")
    known = points.filter("value IS NOT NULL").select(
        "run", "metric", step.alias("step"), F.col("value").cast("double").alias("value")
    )
    return known.groupBy("run", "metric", "step", "value").agg(F.count("*").alias("copies"))


def added(counts: DataFrame) -> DataFrame:
    """Counts of several batches as the counts of all their points."""
    return counts.groupBy("run", "metric", "step", "value").agg(F.sum("copies").alias("copies"))


def count_stream(points: DataFrame, store: str, checkpoint: str, seconds: int = 10) -> StreamingQuery:
    """Count the points of every micro-batch into the store, then stop when all is read."""

    def write(batch: DataFrame, number: int) -> None:
        part = f"{store}/upto={_OPEN}/batch={number}"
        point_counts(batch, seconds).write.mode("overwrite").parquet(part)

    return (
        points.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _current(spark: SparkSession, store: str) -> DataFrame:
    parts = spark.read.schema(_PARTS).parquet(store)
    newest = parts.agg(F.max("upto")).first()[0]
    newest = _OPEN if newest is None else newest
    batches = (F.col("upto") == _OPEN) & (F.col("batch") > newest)
    merged = (F.col("upto") == newest) & (F.col("batch") == _OPEN)
    return parts.filter(merged | batches)


def stored_counts(spark: SparkSession, store: str) -> DataFrame:
    """Counts of all points of the log so far."""
    return added(_current(spark, store))


def merge_counts(spark: SparkSession, store: str) -> None:
    """Write one part that stands for all parts so far; nothing to do without a new batch.

    To be called between streams: a batch that is replayed after its merge would be left out as merged.
    """
    current = _current(spark, store)
    last = current.agg(F.max("batch")).first()[0]
    if last is not None and last != _OPEN:
        added(current.drop("upto", "batch")).write.mode("overwrite").parquet(f"{store}/upto={last}/batch={_OPEN}")


def counted_report(counts: DataFrame, by: Sequence[str] = ("run", "metric")) -> DataFrame:
    """Count, mean, extremes and percentiles by position, as ``run_report`` gives them for the points."""
    ranks = value_ranks(counts, by, "value", weight="copies")
    return ranks.groupBy(*by).agg(
        F.sum("copies").alias("count"),
        (F.sum(F.col("value") * F.col("copies")) / F.sum("copies")).alias("avg"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        *_percentiles(REPORT_SHARES),
    )


def counted_buckets(counts: DataFrame, steps: int = 1, by: Sequence[str] = ("run", "metric")) -> DataFrame:
    """Mean and interpolated p50, p95, p99 per ``bucket`` of several steps of the clock; points without time have none."""
    groups = [*by, "bucket"]
    timed = counts.filter("step IS NOT NULL").withColumn("bucket", F.floor(F.col("step") / steps).cast("bigint"))
    return value_ranks(timed, groups, "value", weight="copies").groupBy(*groups).agg(
        F.sum("copies").alias("count"),
        (F.sum(F.col("value") * F.col("copies")) / F.sum("copies")).alias("mean"),
        *[interpolated("value", s).alias(f"p{round(s * 100)}") for s in (0.50, 0.95, 0.99)],
    )
