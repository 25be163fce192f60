"""Statistics of load-test metric points and comparison of two runs.

Points have ``run``, ``metric``, ``ts``, ``value`` and a tie breaker ``seq``. Percentiles are exact
and come from ``value_ranks``, so neither a long run nor a hot bucket is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.positions import (
    BLOCK_ROWS,
    interpolated,
    lagged,
    number_rows,
    value_at,
    value_ranks,
)

# Percentiles of a report, the metrics that decide a verdict, and metric names.
REPORT_SHARES = (0.50, 0.75, 0.90, 0.95, 0.99)
VERDICT_STATS = ("p50", "p95", "p99", "avg")
METRIC_NAMES = {
    "users": "vus",
    "requests": "http_reqs",
    "duration": "http_req_duration",
    "failed": "http_req_failed",
    "checks": "checks",
    "errors": "errors",
}

# Service goals as (name, role, measure, comparison, limit).
GOALS = (
    ("p50", "duration", 0.50, "<", 200.0),
    ("p95", "duration", 0.95, "<", 500.0),
    ("p99", "duration", 0.99, "<", 1000.0),
    ("failure_rate", "failed", "rate", "<", 0.01),
    ("check_rate", "checks", "rate", ">", 0.99),
)
# Goals of the realistic mix, in the same form.
MIX_GOALS = (
    ("p95", "duration", 0.95, "<", 500.0),
    ("p99", "duration", 0.99, "<", 1000.0),
    ("failed_requests", "failed", "rate", "<", 0.05),
    ("errors", "errors", "rate", "<", 0.05),
)
# Limits of the 95th percentile of durations per scenario.
SCENARIO_GOALS = {"constant_load": 300.0, "spike": 800.0}

WIDEST_STEP = 10


def _name(share: float) -> str:
    return f"p{round(share * 100)}"


def metric_stats(points: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Count, mean, least and greatest value of each metric."""
    return points.groupBy(*by).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("avg"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def metric_percentiles(
    points: DataFrame, by: Sequence[str] = ("metric",), shares: Sequence[float] = REPORT_SHARES
) -> DataFrame:
    """Percentiles by position: the value at index ``floor(count * share)`` of the sorted values."""
    ranks = value_ranks(points, by, "value")
    return ranks.groupBy(*by).agg(*_percentiles(shares))


def _percentiles(shares: Sequence[float]) -> list[Column]:
    return [value_at("value", F.floor(F.col("total") * F.lit(s))).alias(_name(s)) for s in shares]


def run_report(points: DataFrame, by: Sequence[str] = ("run", "metric")) -> DataFrame:
    """Count, mean, extremes and percentiles by position, all from one pass over the points."""
    ranks = value_ranks(points, by, "value")
    return ranks.groupBy(*by).agg(
        F.sum("copies").alias("count"),
        (F.sum(F.col("value") * F.col("copies")) / F.sum("copies")).alias("avg"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        *_percentiles(REPORT_SHARES),
    )


def seconds_since_start(points: DataFrame, clock: str = METRIC_NAMES["users"]) -> DataFrame:
    """Points with ``elapsed`` seconds since the first point of the clock metric in their run.

    A run without a clock point starts at its first point of any metric.
    """
    clocked = F.min(F.when(F.col("metric") == clock, F.col("ts")))
    starts = points.groupBy("run").agg(F.coalesce(clocked, F.min("ts")).alias("_start"))
    joined = points.join(starts, "run")
    return joined.withColumn("elapsed", (_micros("ts") - _micros("_start")) / 1e6).drop("_start")


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def time_buckets(
    points: DataFrame,
    seconds: float = 10,
    *,
    clock: str = METRIC_NAMES["users"],
    by: Sequence[str] = ("run", "metric"),
) -> DataFrame:
    """Mean and interpolated p50, p95, p99 of each metric per time bucket since the run start."""
    timed = seconds_since_start(points, clock)
    bucketed = timed.withColumn("time_bucket", F.floor(F.col("elapsed") / seconds) * F.lit(seconds))
    groups = [*by, "time_bucket"]
    return value_ranks(bucketed, groups, "value").groupBy(*groups).agg(
        (F.sum(F.col("value") * F.col("copies")) / F.sum("copies")).alias("mean"),
        *[interpolated("value", s).alias(_name(s)) for s in (0.50, 0.95, 0.99)],
    )


def request_rate(
    points: DataFrame, *, clock: str = METRIC_NAMES["users"], block: int = BLOCK_ROWS
) -> DataFrame:
    """Growth of each metric over ``w`` points, timed by the clock metric.

    ``w`` is 10, or half the points of a shorter series. Rows are aligned by position: the n-th
    point of a metric gets the time of the run's n-th clock point, and the shorter series ends the
    result. The first ``w`` rows have no rate and are dropped. Returns ``run, metric, position,
    elapsed, rate``.
    """
    series = ["run", "metric"]
    numbered = number_rows(
        points.select(*series, "ts", "seq", "value"), [*series, "ts", "seq"], out="_number"
    )
    sizes = numbered.groupBy(*series).agg(
        F.min("_number").alias("_first"), F.count("*").alias("_points")
    )
    placed = numbered.join(sizes, series).withColumn(
        "position", F.col("_number") - F.col("_first") + 1
    )
    is_clock = F.col("metric") == clock
    others = placed.filter(~is_clock)
    full = F.col("_points") >= 2 * WIDEST_STEP
    long = lagged(others.filter(full), series, "position", "value", WIDEST_STEP, "_earlier", block)
    # A shorter series has fewer points than this, so its window is tiny.
    in_order = Window.partitionBy(*series).orderBy("position")
    steps = [F.lag("value", n).over(in_order) for n in range(1, WIDEST_STEP)]
    half = F.floor(F.col("_points") / 2).cast("int")
    short = others.filter(~full & (F.col("_points") > 1)).withColumn(
        "_earlier", F.get(F.array(*steps), half - 1)
    )
    rates = long.unionByName(short).withColumn(
        "_step", F.least(F.lit(WIDEST_STEP), F.floor(F.col("_points") / 2))
    )
    rates = rates.filter(F.col("position") > F.col("_step")).select(
        *series, "position", (F.col("value") - F.col("_earlier")).alias("rate")
    )
    clocks = seconds_since_start(placed.filter(is_clock), clock)
    enough = clocks.filter(F.col("_points") > WIDEST_STEP).select("run", "position", "elapsed")
    return rates.join(enough, ["run", "position"]).select(*series, "position", "elapsed", "rate")


def run_summary(points: DataFrame, names: Mapping[str, str] = METRIC_NAMES) -> DataFrame:
    """Totals of each run in one aggregate.

    ``last_requests`` is the last reported request value (zero for fewer than two points), which
    reports show as the total; ``requests`` is the real sum.
    """
    metric, value = F.col("metric"), F.col("value")

    def of(role: str) -> Column:
        return F.when(metric == names[role], value)

    moment = F.when(metric == names["requests"], F.struct("ts", "seq"))
    return points.groupBy("run").agg(
        F.when(F.count(of("requests")) > 1, F.max_by(of("requests"), moment))
        .otherwise(0.0)
        .alias("last_requests"),
        F.coalesce(F.sum(of("requests")), F.lit(0.0)).alias("requests"),
        F.coalesce(F.sum(of("failed")), F.lit(0.0)).alias("failures"),
        F.coalesce(F.avg(of("checks")) * 100, F.lit(0.0)).alias("success_rate"),
        F.max(of("users")).alias("max_users"),
        F.count(of("users")).alias("user_points"),
    )


def compare_runs(report: DataFrame, base: str, other: str) -> DataFrame:
    """Base and other run side by side for every statistic that both have.

    Change is in percent of the base, zero for a zero base; lower is better. A count has neither.
    """
    stats = [c for c in report.columns if c not in ("run", "metric")]
    doubles = report.select("run", "metric", *[F.col(c).cast("double").alias(c) for c in stats])
    compared = doubles.filter(F.col("run").isin(base, other))
    long = compared.unpivot(["run", "metric"], stats, "stat", "value")

    def of(run: str) -> Column:
        return F.max(F.when(F.col("run") == run, F.col("value")))

    pairs = long.groupBy("metric", "stat").agg(of(base).alias("base"), of(other).alias("other"))
    pairs = pairs.filter(F.col("base").isNotNull() & F.col("other").isNotNull())
    change = F.when(F.col("base") != 0, (F.col("other") - F.col("base")) / F.col("base") * 100)
    sign = F.when(F.col("other") < F.col("base"), "better").when(F.col("other") > F.col("base"), "worse")
    is_count = F.col("stat") == "count"
    return pairs.select(
        "metric",
        "stat",
        "base",
        "other",
        (F.col("other") - F.col("base")).alias("diff"),
        F.when(~is_count, F.coalesce(change, F.lit(0.0))).alias("pct_change"),
        F.when(~is_count, F.coalesce(sign, F.lit("equal"))).alias("verdict"),
    )


def verdict(comparison: DataFrame) -> DataFrame:
    """Per metric: how many deciding statistics improved, and whether more than half did."""
    decisive = comparison.filter(F.col("stat").isin(*VERDICT_STATS) & (F.col("base") > 0))
    improved = F.count_if(F.col("other") < F.col("base"))
    return decisive.groupBy("metric").agg(
        improved.alias("improved"),
        F.count("*").alias("compared"),
        (improved > F.count("*") / 2).alias("other_wins"),
    )


def service_goals(
    points: DataFrame,
    names: Mapping[str, str] = METRIC_NAMES,
    goals: Sequence[tuple] = GOALS,
    by: Sequence[str] = (),
) -> DataFrame:
    """Each goal with the measured value and whether it is met, per group.

    Percentiles are interpolated; a rate is the mean of its points. A goal without points is absent.
    """
    used = points.filter(F.col("metric").isin(*{names[goal[1]] for goal in goals}))
    groups = [*by, "metric"]
    parts = []
    spans = [goal for goal in goals if goal[2] != "rate"]
    if spans:
        timed = used.filter(F.col("metric").isin(*{names[goal[1]] for goal in spans}))
        measures = [interpolated("value", goal[2]).alias(goal[0]) for goal in spans]
        measured = value_ranks(timed, groups, "value").groupBy(*groups).agg(*measures)
        parts.append(_goal_rows(measured, by, names, [(g, F.col(g[0])) for g in spans]))
    rates = [goal for goal in goals if goal[2] == "rate"]
    if rates:
        means = used.groupBy(*groups).agg(F.avg("value").alias("_mean"))
        parts.append(_goal_rows(means, by, names, [(g, F.col("_mean")) for g in rates]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _goal_rows(
    measured: DataFrame, by: Sequence[str], names: Mapping[str, str], goals: Sequence[tuple]
) -> DataFrame:
    """One row per goal of the metric that a measured row belongs to."""
    rows = []
    for (name, role, _, comparison, limit), value in goals:
        met = value < limit if comparison == "<" else value > limit
        rows.append(
            F.struct(
                F.lit(names[role]).alias("_of"),
                F.lit(name).alias("goal"),
                value.alias("measured"),
                F.lit(float(limit)).alias("limit"),
                met.alias("met"),
            )
        )
    each = measured.select(*by, "metric", F.inline(F.array(*rows)))
    return each.filter(F.col("metric") == F.col("_of")).drop("metric", "_of")


def mix_goals(
    points: DataFrame,
    names: Mapping[str, str] = METRIC_NAMES,
    goals: Sequence[tuple] = MIX_GOALS,
    by: Sequence[str] = ("scenario",),
) -> DataFrame:
    """Goals of a realistic mix of requests per scenario: late percentiles, failed requests and errors."""
    return service_goals(points, names, goals, by)


def scenario_goals(
    points: DataFrame,
    limits: Mapping[str, float] = SCENARIO_GOALS,
    duration: str = METRIC_NAMES["duration"],
) -> DataFrame:
    """95th percentile of durations per scenario against the scenario's own limit."""
    timed = points.filter((F.col("metric") == duration) & F.col("scenario").isin(*limits))
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    measured = value_ranks(timed, ["scenario"], "value").groupBy("scenario").agg(
        interpolated("value", 0.95).alias("p95")
    )
    return measured.withColumn("limit", limit[F.col("scenario")]).withColumn(
        "met", F.col("p95") < F.col("limit")
    )
