"""Readers of newline-delimited JSON metric logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.schemas import METRIC_LOG_SCHEMA


def read_metric_log(spark: SparkSession, path: str, run: str, *, strict: bool = False) -> DataFrame:
    """Points of a log as ``run, metric, ts, value, scenario, seq``.

    Malformed lines are skipped, or fail the read when ``strict``. Equal times keep the order of the file.
    """
    lines = spark.read.schema(METRIC_LOG_SCHEMA).json(
        path, mode="FAILFAST" if strict else "DROPMALFORMED"
    )
    return points(lines, run, strict=strict)


def points(lines: DataFrame, run: str, *, strict: bool = False) -> DataFrame:
    """Metric points of parsed log lines; other line types are left out.

    A time that cannot be read is null, or an error when ``strict``.
    """
    moment = F.to_timestamp if strict else F.try_to_timestamp
    return lines.filter(F.col("type") == "Point").select(
        F.lit(run).alias("run"),
        "metric",
        moment(F.col("data.time")).alias("ts"),
        F.col("data.value").alias("value"),
        F.col("data.tags.scenario").alias("scenario"),
        # Grows along each file, and from file to file in the order in which they are read.
        F.monotonically_increasing_id().alias("seq"),
    )
