"""Connected components of a link table, by joins that pass on the smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.plans.staging import staged


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, label`` for every node of the links ``a, b``; the label is the component's least node.

    Each round takes the least label among a node's neighbours, then the label of its label, so long
    chains halve. Every round is written to the shared folder. Nulls are no nodes.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL AND a != b").select("a", "b")
    both = staged(links.union(links.select(F.col("b"), F.col("a"))).distinct())
    now = staged(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")))
    for _ in range(rounds):
        # The label of the label first: what it points to is never greater.
        up = now.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = now.join(up, "label", "left").select(
            "node", F.col("label").alias("was"), F.coalesce("further", "label").alias("label")
        )
        jumped = staged(jumped)
        seen = both.join(jumped.select(F.col("node").alias("b"), "label"), "b")
        least = seen.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        joined = jumped.join(least, "node").select("node", "was", F.least("label", "near").alias("label"))
        now = staged(joined)
        if now.filter("label != was").isEmpty():
            return now.select("node", "label")
        now = now.select("node", "label")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
