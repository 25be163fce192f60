import random

import pytest

from newsloom.operators import metrics
from newsloom.sources.metric_logs import read_metric_log

SCHEMA = "run string, metric string, ts timestamp, value double, scenario string, seq double"


@pytest.fixture(scope="module")
def log(spark, fixtures):
    return read_metric_log(spark, str(fixtures / "run.ndjson"), "base")


def by_position(values):
    ordered, n = sorted(values), len(values)
    return {f"p{round(s * 100)}": ordered[int(n * s)] for s in metrics.REPORT_SHARES}


def linear(values, share):
    ordered = sorted(values)
    place = share * (len(ordered) - 1)
    low = int(place)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (place - low)


DURATIONS = [float((i * 37) % 101) for i in range(40)]


def test_broken_lines_are_skipped_or_fail(spark, fixtures, log):
    broken = str(fixtures / "run_broken.ndjson")
    assert read_metric_log(spark, broken, "base").count() == log.count() == 91
    with pytest.raises(Exception, match="[Mm]alformed"):
        read_metric_log(spark, broken, "base", strict=True).collect()
    assert read_metric_log(spark, str(fixtures / "run.ndjson"), "base", strict=True).count() == 91


def test_stats_and_percentiles_by_position(spark, log):
    row = {r.metric: r for r in metrics.metric_stats(log).collect()}["http_req_duration"]
    assert (row["count"], row.min, row.max) == (40, min(DURATIONS), max(DURATIONS))
    assert row.avg == pytest.approx(sum(DURATIONS) / 40)
    got = {r.metric: r for r in metrics.metric_percentiles(log).collect()}["http_req_duration"]
    assert got.asDict() == {"metric": "http_req_duration", **by_position(DURATIONS)}
    four = spark.createDataFrame([("r", "m", None, float(v), None, 0.0) for v in (4, 1, 3, 2)], SCHEMA)
    assert metrics.metric_percentiles(four, shares=[0.5]).first().p50 == 3.0


def test_report_equals_its_parts(log):
    report = {r.metric: r for r in metrics.run_report(log).collect()}
    for part in metrics.metric_stats(log).collect():
        for name in ("count", "avg", "min", "max"):
            assert report[part.metric][name] == pytest.approx(part[name])


def test_time_buckets(log):
    got = {r.time_bucket: r for r in metrics.time_buckets(log, 10).filter("metric = 'http_req_duration'").collect()}
    assert sorted(got) == [0, 10, 20]
    for start, row in got.items():
        own = [v for i, v in enumerate(DURATIONS) if start <= i * 0.6 < start + 10]
        assert row.mean == pytest.approx(sum(own) / len(own))
        for share in (0.5, 0.95, 0.99):
            assert row[f"p{round(share * 100)}"] == pytest.approx(linear(own, share))


@pytest.mark.parametrize("block", [16, 1_000_000])
def test_request_rate(log, block):
    rows = metrics.request_rate(log, block=block).filter("metric = 'http_reqs'").orderBy("position").collect()
    values = [float(i * i) for i in range(22)]
    assert [r.rate for r in rows] == [values[i] - values[i - 10] for i in range(10, 22)]
    assert [r.elapsed for r in rows] == [float(i) for i in range(10, 22)]


def test_request_rate_of_a_short_series(log):
    checks = metrics.request_rate(log).filter("metric = 'checks'").orderBy("position").collect()
    values = [1.0, 1.0, 0.0, 1.0, 1.0]
    assert [r.rate for r in checks] == [values[i] - values[i - 2] for i in range(2, 5)]


def test_no_rate_without_enough_clock_points(log):
    assert metrics.request_rate(log, clock="checks").count() == 0


def test_run_summary(spark, log):
    row = metrics.run_summary(log).first()
    assert row.last_requests == 441.0
    assert row.requests == sum(i * i for i in range(22))
    assert (row.failures, row.success_rate) == (0.0, 80.0)
    assert (row.max_users, row.user_points) == (6.0, 24)
    single = log.filter("metric = 'http_reqs'").limit(1)
    assert metrics.run_summary(single).first().last_requests == 0.0
    assert metrics.run_summary(single).first().success_rate == 0.0


def test_comparison_and_verdict(spark):
    rng = random.Random(5)
    base = [round(rng.uniform(1, 100), 2) for _ in range(101)]
    rows = [("sync", "d", None, v, None, 0.0) for v in base]
    rows += [("async", "d", None, v * 0.9, None, 0.0) for v in base[:50]]
    rows += [("sync", "zero", None, 0.0, None, 0.0), ("async", "zero", None, 1.0, None, 0.0)]
    rows += [("sync", "lonely", None, 1.0, None, 0.0)]
    report = metrics.run_report(spark.createDataFrame(rows, SCHEMA))
    compared = metrics.compare_runs(report, "sync", "async")
    got = {(r.metric, r.stat): r for r in compared.collect()}
    assert not any(metric == "lonely" for metric, _ in got)
    p95 = got["d", "p95"]
    assert p95.base == sorted(base)[int(101 * 0.95)]
    assert p95.pct_change == pytest.approx((p95.other - p95.base) / p95.base * 100)
    assert got["d", "count"].pct_change is None and got["d", "count"].diff == -51.0
    assert got["zero", "avg"].pct_change == 0.0 and got["zero", "avg"].verdict == "worse"
    verdicts = {r.metric: r for r in metrics.verdict(compared).collect()}
    better = sum(got["d", s].other < got["d", s].base for s in ("p50", "p95", "p99", "avg"))
    assert (verdicts["d"].improved, verdicts["d"].compared) == (better, 4)
    assert verdicts["d"].other_wins == (better > 2)
    assert "zero" not in verdicts


def test_service_goals(log):
    got = {r.goal: r for r in metrics.service_goals(log).collect()}
    assert got["p95"].measured == pytest.approx(linear(DURATIONS, 0.95)) and got["p95"].met
    assert got["check_rate"].measured == pytest.approx(0.8) and not got["check_rate"].met
    assert "failure_rate" not in got


def test_scenario_goals(log):
    got = {r.scenario: r for r in metrics.scenario_goals(log).collect()}
    spikes = [v for i, v in enumerate(DURATIONS) if i % 2]
    assert got["spike"].p95 == pytest.approx(linear(spikes, 0.95))
    assert (got["spike"].limit, got["constant_load"].limit) == (800.0, 300.0)
    assert got["spike"].met and got["constant_load"].met


def test_a_run_without_a_clock_keeps_its_points(spark):
    rows = [("a", "d", f"2025-01-01 00:00:0{i}", float(i), None, float(i)) for i in range(5)]
    points = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts string"))
    buckets = metrics.time_buckets(points.withColumn("ts", points.ts.cast("timestamp")), 2).collect()
    assert sorted((r.time_bucket, r.mean) for r in buckets) == [(0.0, 0.5), (2.0, 2.5), (4.0, 4.0)]


def test_goals_of_a_mix_of_requests(spark):
    names = {"duration": "d", "failed": "f", "errors": "e"}
    rows = [("a", "d", None, 100.0 + i, "spike", 0.0) for i in range(100)]
    rows += [("a", "f", None, float(i < 4), "spike", 0.0) for i in range(100)]
    rows += [("a", "e", None, float(i < 6), "spike", 0.0) for i in range(100)]
    got = {r.goal: (round(r.measured, 6), r.met) for r in metrics.mix_goals(spark.createDataFrame(rows, SCHEMA), names).collect()}
    assert got == {"p95": (194.05, True), "p99": (198.01, True), "failed_requests": (0.04, True), "errors": (0.06, False)}
