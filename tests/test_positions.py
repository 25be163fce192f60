import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators.positions import interpolated, lagged, number_rows, value_at, value_ranks


def hot_rows(seed, n=3000):
    """A third of all rows share one group and one value."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            rows.append((i, "hot", 5.0))
        else:
            rows.append((i, rng.choice(["hot", "a", "b"]), round(rng.lognormvariate(0, 2), 3)))
    return rows


@pytest.mark.parametrize("seed", [1, 4, 5])
def test_value_ranks_and_percentiles(spark, seed):
    rows = hot_rows(seed)
    frame = spark.createDataFrame(rows, "id long, g string, v double").repartition(7)
    ranks = value_ranks(frame, ["g"], "v")
    got = {
        r.g: r
        for r in ranks.groupBy("g")
        .agg(
            value_at("v", F.floor(F.col("total") * 0.9)).alias("p90"),
            interpolated("v", 0.95).alias("q95"),
            F.sum("copies").alias("n"),
            F.max("upto").alias("upto"),
        )
        .collect()
    }
    for g in ("hot", "a", "b"):
        values = sorted(v for _, name, v in rows if name == g)
        place = 0.95 * (len(values) - 1)
        low, part = int(place), place - int(place)
        assert got[g].n == got[g].upto == len(values)
        assert got[g].p90 == values[int(len(values) * 0.9)]
        assert got[g].q95 == pytest.approx(values[low] + (values[low + 1] - values[low]) * part)


def test_value_ranks_with_null_groups_and_values(spark):
    frame = spark.createDataFrame(
        [(None, 1.0), (None, 2.0), ("x", None), ("x", 3.0)] * 5, "g string, v double"
    )
    rows = value_ranks(frame, ["g"], "v").collect()
    assert {(r.g, r.v, r.before, r.upto, r.total) for r in rows} == {
        (None, 1.0, 0, 5, 10),
        (None, 2.0, 5, 10, 10),
        ("x", 3.0, 0, 5, 5),
    }


def test_number_rows_is_gapless_in_order(spark):
    frame = spark.createDataFrame(hot_rows(2), "id long, g string, v double").repartition(9)
    numbered = number_rows(frame, [F.desc("v"), F.asc("id")]).collect()
    expected = sorted(hot_rows(2), key=lambda r: (-r[2], r[0]))
    got = [(r.id, r.g, r.v) for r in sorted(numbered, key=lambda r: r.position)]
    assert got == expected
    assert sorted(r.position for r in numbered) == list(range(1, len(expected) + 1))


def test_number_rows_uses_no_single_task_window_over_rows(spark):
    numbered = number_rows(spark.range(1000).repartition(5), ["id"])
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert plan.index("HashAggregate") > plan.index("Window")  # the window sees counts only


def test_number_rows_of_nothing(spark):
    assert number_rows(spark.range(0), ["id"]).count() == 0


@pytest.mark.parametrize("block", [10, 16, 64, 5000])
def test_lagged_across_blocks(spark, block):
    rows = [("a", i + 1, float(i * i)) for i in range(200)] + [("b", i + 1, float(i)) for i in range(5)]
    frame = spark.createDataFrame(rows, "g string, position long, v double").repartition(6)
    got = {(r.g, r.position): r.old for r in lagged(frame, ["g"], "position", "v", 10, "old", block).collect()}
    values = {(g, position): v for g, position, v in rows}
    assert got == {(g, position): values.get((g, position - 10)) for g, position in values}


def test_lagged_needs_blocks_as_long_as_the_step(spark):
    with pytest.raises(ValueError):
        lagged(spark.range(5), [], "id", "id", 10, "old", 9)
