"""Results written once to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.getCheckpointDir():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="newsloom-")
        context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(frame: DataFrame) -> DataFrame:
    """``frame`` written as a table to the shared checkpoint folder and read back.

    Used where several branches must see the very same rows, or where a costly step would otherwise
    run once per branch. The table survives lost executors, and each branch reads only its columns.
    """
    spark = frame.sparkSession
    path = shared_path(spark, "staged")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """At most ``rows`` rows travel to Python at once, in what is written meanwhile."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, rows)
    try:
        yield
    finally:
        spark.conf.set(setting, before)
