import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators.metrics import run_report
from newsloom.streaming.metric_counts import (
    added,
    count_stream,
    counted_buckets,
    counted_report,
    merge_counts,
    point_counts,
    stored_counts,
)

SCHEMA = "run string, metric string, ts timestamp, value double, seq long"


def drawn(seed, n):
    rng = random.Random(seed)
    start = dt.datetime(2025, 1, 1)
    return [
        (f"r{rng.randint(0, 1)}", rng.choice("ab"), start + dt.timedelta(seconds=rng.randint(0, 300)), float(rng.randint(0, 30)), i)
        for i in range(n)
    ]


def reported(frame):
    return {(r.run, r.metric): tuple(r)[2:] for r in frame.collect()}


def test_two_batches_equal_one(spark, tmp_path):
    rows = drawn(1, 900)
    landed, store, notes = (str(tmp_path / name) for name in ("landed", "store", "notes"))
    whole = run_report(spark.createDataFrame(rows, SCHEMA))
    for at in (0, 300, 600):
        spark.createDataFrame(rows[at : at + 300], SCHEMA).write.mode("append").parquet(landed)
        count_stream(spark.readStream.schema(SCHEMA).parquet(landed), store, notes, 60).awaitTermination()
        if at == 300:
            merge_counts(spark, store)
            merge_counts(spark, store)
    got, expected = reported(counted_report(stored_counts(spark, store))), reported(whole)
    assert got.keys() == expected.keys()
    for key, row in expected.items():
        assert got[key] == pytest.approx(row)
    before = stored_counts(spark, store).count()
    merge_counts(spark, store)
    assert stored_counts(spark, store).count() == before
    assert stored_counts(spark, store).agg(F.sum("copies")).first()[0] == 900


def test_a_replayed_batch_counts_once(spark, tmp_path):
    points = spark.createDataFrame(drawn(2, 50), SCHEMA)
    store = str(tmp_path / "store")
    for _ in range(2):
        point_counts(points, 60).write.mode("overwrite").parquet(f"{store}/upto=-1/batch=0")
    assert stored_counts(spark, store).agg(F.sum("copies")).first()[0] == 50


def test_buckets_of_counts(spark):
    rows = drawn(3, 400)
    counts = added(point_counts(spark.createDataFrame(rows[:150], SCHEMA), 60).union(point_counts(spark.createDataFrame(rows[150:], SCHEMA), 60)))
    got = {(r.run, r.metric, r.bucket): r for r in counted_buckets(counts, 2).collect()}
    groups = {}
    for run, metric, ts, value, _ in rows:
        second = int((ts - dt.datetime(1970, 1, 1)).total_seconds())
        groups.setdefault((run, metric, second // 120), []).append(value)
    assert got.keys() == groups.keys()
    for key, values in groups.items():
        assert got[key]["count"] == len(values)
        assert got[key].mean == pytest.approx(sum(values) / len(values))
        values.sort()
        place = (len(values) - 1) * 0.95
        low = int(place)
        high = min(low + 1, len(values) - 1)
        assert got[key].p95 == pytest.approx(values[low] + (values[high] - values[low]) * (place - low))


def test_odd_points(spark, tmp_path):
    start = dt.datetime(2025, 1, 1)
    rows = [("r", "a", None, 1.0, 0), ("r", "a", start, None, 1), (None, None, start, 2.0, 2), ("r", "a", start, 1.0, 3)]
    counts = point_counts(spark.createDataFrame(rows, SCHEMA), 60)
    assert {(r.run, r.metric): (r["count"], r.avg) for r in counted_report(counts).collect()} == {("r", "a"): (2, 1.0), (None, None): (1, 2.0)}
    assert sum(r["count"] for r in counted_buckets(counts).collect()) == 2
    store = str(tmp_path / "store")
    point_counts(spark.createDataFrame([], SCHEMA), 60).write.parquet(f"{store}/upto=-1/batch=0")
    assert stored_counts(spark, store).count() == 0
    merge_counts(spark, store)
