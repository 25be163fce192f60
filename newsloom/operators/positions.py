"""Exact ranks without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.plans.staging import staged

BLOCK_ROWS = 1_000_000

_PARTITION_BITS = 33

# Bound up to which Spark itself cuts a row number in each task, and the parts of a group beyond it.
_CUT_BY_SPARK = 1000
_GROUP_PARTS = 64


def number_rows(frame: DataFrame, order: Sequence[Column | str], out: str = "position") -> DataFrame:
    """Rows numbered from 1 in a total order, without a single-task window.

    A range sort spreads the rows, so the order should be free of long ties. Each row is tagged with
    its partition and its place there; the tagged rows are staged, so that the counts which give
    every partition its start belong to the same sort. Only those counts are gathered, one row per
    partition.
    """
    tagged = staged(frame.orderBy(*order).withColumn("_tag", F.monotonically_increasing_id()))
    part = F.shiftright("_tag", _PARTITION_BITS)
    counts = tagged.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    starts = counts.select(
        "_part",
        (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_start"),
    )
    place = F.col("_tag").bitwiseAND((1 << _PARTITION_BITS) - 1)
    numbered = tagged.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return numbered.withColumn(out, F.col("_start") + place + 1).drop("_tag", "_part", "_start")


def first_per_group(
    frame: DataFrame, groups: Sequence[str], order: Sequence[Column | str], limit: int, out: str = "place"
) -> DataFrame:
    """The first ``limit`` rows of each group with their place, without gathering a group in one task.

    Up to a literal 1,000 each task drops all but its own first rows before the shuffle. Beyond, a group is
    cut into parts by a hash, each part keeps its first rows, and only those meet.
    """
    if limit > _CUT_BY_SPARK:
        part = F.pmod(F.xxhash64(*frame.columns), F.lit(_GROUP_PARTS))
        inside = Window.partitionBy(*groups, "_part").orderBy(*order)
        cut = frame.withColumn("_part", part).withColumn(out, F.row_number().over(inside))
        frame = cut.filter(F.col(out) <= limit).drop("_part", out)
    placed = frame.withColumn(out, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return placed.filter(F.col(out) <= limit)


def value_ranks(frame: DataFrame, groups: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct values of each group with the ranks they cover, exactly.

    Returns the groups, the value, ``copies``, and ``before``, ``upto``, ``total``: the value holds
    the zero-based ranks ``before <= r < upto`` of ``total``. Equal values collapse inside each
    task first. The distinct values are range-sorted over all tasks and summed there; what comes
    before each part is one number per part, and where a group begins one number per group.
    """
    known = frame.filter(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    copies = F.count("*") if weight is None else F.sum(weight)
    counts = known.groupBy(*groups, value).agg(copies.alias("copies"))
    tagged = staged(counts.orderBy(*groups, value).withColumn("_tag", F.monotonically_increasing_id()))
    part = F.shiftright("_tag", _PARTITION_BITS)
    sums = tagged.groupBy(part.alias("_part")).agg(F.sum("copies").alias("_rows"))
    starts = sums.select(
        "_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_start")
    )
    inside = Window.partitionBy("_part").orderBy("_tag")
    local = tagged.withColumn("_part", part).withColumn("_local", F.sum("copies").over(inside))
    # One row per partition.
    summed = local.join(F.broadcast(starts), "_part")
    summed = summed.withColumn("_upto", F.col("_start") + F.col("_local")).alias("summed")
    begins = summed.groupBy(*groups).agg(
        F.min(F.col("_upto") - F.col("copies")).alias("_begin"), F.sum("copies").alias("total")
    ).alias("begins")
    same_group = F.lit(True)
    for group in groups:
        same_group &= F.expr(f"summed.`{group}` <=> begins.`{group}`")
    joined = summed.join(begins, same_group)
    upto = F.col("_upto") - F.col("_begin")
    return joined.select(
        *[f"summed.{group}" for group in groups],
        f"summed.{value}",
        "summed.copies",
        (upto - F.col("copies")).alias("before"),
        upto.alias("upto"),
        "total",
    )


def value_at(value: str, rank: Column) -> Column:
    """Aggregate over ``value_ranks`` rows of one group: the value that holds a rank."""
    holds = (F.col("before") <= rank) & (rank < F.col("upto"))
    return F.max(F.when(holds, F.col(value)))


def interpolated(value: str, share: float) -> Column:
    """Aggregate over ``value_ranks`` rows of one group: linearly interpolated percentile."""
    place = (F.col("total") - 1) * F.lit(float(share))
    low = value_at(value, F.floor(place))
    high = value_at(value, F.ceil(place))
    part = F.max(place - F.floor(place))
    return low + (high - low) * part


def lagged(
    numbered: DataFrame,
    groups: Sequence[str],
    position: str,
    value: str,
    steps: int,
    out: str,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Value of the row ``steps`` positions earlier in its group, null for the first rows.

    Positions are cut into blocks; the last ``steps`` rows of a block are also sent to the next one,
    so each block is complete on its own and a long series is spread over many tasks.
    """
    if block < steps:
        raise ValueError(f"a block must hold at least {steps} rows")
    place = F.col(position) - 1
    home = F.floor(place / block)
    spills = place % block >= block - steps
    homes = F.when(spills, F.array(home, home + 1)).otherwise(F.array(home))
    copies = numbered.withColumn("_block", F.explode(homes))
    in_block = Window.partitionBy(*groups, "_block").orderBy(position)
    found = copies.withColumn(out, F.lag(value, steps).over(in_block))
    return found.filter(F.col("_block") == home).drop("_block")
