"""Counts observed during a run, and first rows of a group for any bound."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators.positions import first_per_group
from newsloom.operators.recency import newest_per_source
from newsloom.operators.reports import RunReport
from newsloom.plans.review import fetch
from newsloom.plans.staging import staged
from newsloom.sources.subscriptions import register_reader, reader_of

AS_OF = dt.datetime(2025, 10, 20, 12)


def test_watched_rows_pass_unchanged(spark):
    articles = spark.createDataFrame([(i, ("rss", "reddit", None)[i % 3]) for i in range(10)], "id int, source string")
    report = RunReport()
    first = report.watch(articles.repartition(3), "all")
    kept = report.watch_kind(first.filter("source = 'rss'"), "rss", even=F.col("id") % 2 == 0, none=F.lit(None).cast("boolean"))
    assert sorted(r.id for r in staged(kept).collect()) == [0, 3, 6, 9]
    assert report.rows() == [
        ("all", "rss", 4), ("all", "reddit", 3), ("all", "bluesky", 0), ("even", "rss", 2), ("none", "rss", 0),
    ]
    assert report.table(spark).count() == 5


def test_fetch_reports(spark, tmp_path):
    (tmp_path / "forum").mkdir()
    line = '{"title": "t%d", "created_utc": %d, "subreddit": "s%d", "permalink": "/p%d", "score": 1}\n'
    at = int(AS_OF.replace(tzinfo=dt.UTC).timestamp())
    lines = [line % (i, at - i * 86_400, i % 2, i) for i in range(30)] + ['{"title": "cut', "no json"]
    (tmp_path / "forum" / "a.json").write_text("".join(lines))
    report = RunReport()
    settings = {"RSS_FETCH": "no", "BLUESKY_FETCH": "no"}
    articles = fetch(spark, {"reddit": str(tmp_path / "forum")}, AS_OF, 10, 8, settings, report)
    counts = {(stage, source): n for stage, source, n in report.rows()}
    assert articles.count() == 10
    assert counts["newest", "reddit"] == 16 and counts["recent", "reddit"] == 10
    assert counts["read", "reddit"] == 30 and counts["broken", "reddit"] == 1  # one line: the first cut text runs into it
    assert counts["recent", "rss"] == 0


def test_readers_without_a_watch(spark, tmp_path):
    before = reader_of("reddit")
    rows = [("t", "s", "l", AS_OF - dt.timedelta(days=1), "x", "0", "reddit", "r/x")]
    schema = "title string, summary string, link string, published_ts timestamp, published string, score string, source string, source_name string"
    register_reader("reddit", lambda spark, path: spark.createDataFrame(rows, schema))
    try:
        report = RunReport()
        fetch(spark, {"reddit": str(tmp_path)}, AS_OF, settings={"RSS_FETCH": "no", "BLUESKY_FETCH": "no"}, report=report)
        assert ("recent", "reddit", 1) in report.rows()
    finally:
        register_reader("reddit", before)


@pytest.mark.parametrize("limit", [3, 1200])
def test_first_rows_of_a_group(spark, limit):
    pick = random.Random(1)
    rows = [(i, pick.choice(["hot"] * 6 + ["a", "b", None]), pick.randrange(500)) for i in range(4000)]
    frame = spark.createDataFrame(rows, "id int, source string, rank int").repartition(5)
    got = first_per_group(frame, ["source"], ["rank", "id"], limit).collect()
    for source in {r[1] for r in rows}:
        expected = sorted((r for r in rows if r[1] == source), key=lambda r: (r[2], r[0]))[:limit]
        assert sorted((r.place, r.id) for r in got if r.source == source) == [(n, r[0]) for n, r in enumerate(expected, 1)]


def test_a_large_cap_is_cut_before_sources_meet(spark):
    rows = spark.range(20).select(
        F.col("id").alias("article_id"), F.lit("s").alias("source_name"), F.current_timestamp().alias("published_ts")
    )
    plan = newest_per_source(rows, 5000)._jdf.queryExecution().executedPlan().toString()
    first = plan.rindex("Window")
    assert plan.count("Window [") == 2 and "_part" in plan[first:] and "<= 5000" in plan[:first]
