"""Balanced choice of a fixed number of articles across source kinds."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.positions import first_per_group
from newsloom.plans.staging import staged
from newsloom.schemas import SOURCE_KINDS, source_ordinal

# Default shares of the kinds in percent, and their weights for free slots.
DEFAULT_SHARES = {"rss": 50.0, "reddit": 30.0, "bluesky": 20.0}
FREE_SLOT_WEIGHTS = {"rss": 1.5, "reddit": 1.0, "bluesky": 1.2}


@dataclass(frozen=True)
class Balance:
    """How many articles to choose, and how to share them between the kinds.

    When feeds make up less than ``boost_below`` of the candidates, a third of the feed quota
    becomes free slots.
    """

    total: int = 15
    shares: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_SHARES))
    boost_below: float = 0.3

    @property
    def quotas(self) -> dict[str, int]:
        return {kind: ceil(self.total * float(self.shares[kind]) / 100) for kind in SOURCE_KINDS}

    @property
    def free_slots(self) -> int:
        return max(0, self.total - sum(self.quotas.values()))

    @property
    def boost_slots(self) -> int:
        return self.quotas["rss"] // 3


def feed_share(candidates: DataFrame) -> DataFrame:
    """Share of feed articles among the candidates, one row; zero when there are none."""
    feeds = F.count_if(F.col("source") == "rss")
    return candidates.agg(
        (feeds / F.greatest(F.count("*"), F.lit(1))).cast("double").alias("feed_share")
    )


def source_quotas(candidates: DataFrame, balance: Balance) -> DataFrame:
    """Quota per kind and free slots after the boost rule, one row."""
    boosted = F.col("feed_share") < balance.boost_below
    moved = F.when(boosted, balance.boost_slots).otherwise(0)
    quotas = balance.quotas
    return feed_share(candidates).select(
        "feed_share",
        (F.lit(quotas["rss"]) - moved).alias("rss_min"),
        F.lit(quotas["reddit"]).alias("reddit_min"),
        F.lit(quotas["bluesky"]).alias("bluesky_min"),
        (F.lit(balance.free_slots) + moved).alias("flexible"),
    )


def guaranteed(
    candidates: DataFrame, balance: Balance, order: str = "seq", best_by: str | None = None
) -> DataFrame:
    """First articles of each kind up to its quota, in input order, with their ``place``.

    Input order counts, not score, unless ``best_by`` names a score column. The literal bound prunes inside each task before the
    shuffle; the exact quota, which depends on the boost, is applied to what is left.
    """
    kinds = [F.lit(kind) for kind in SOURCE_KINDS]
    quotas = source_quotas(candidates, balance).select(
        F.map_from_arrays(F.array(*kinds), F.array("rss_min", "reddit_min", "bluesky_min"))
    )
    first = [F.asc(order)]
    if best_by:
        first.insert(0, F.desc(F.col(best_by).cast("double")))
    known = candidates.filter(F.col("source").isin(*SOURCE_KINDS))
    placed = first_per_group(known, ["source"], first, max(balance.quotas.values()))
    return placed.filter(F.col("place") <= F.element_at(quotas.scalar(), F.col("source")))


def _weighted(score: str) -> Column:
    weight = F.lit(None).cast("double")
    for kind, factor in FREE_SLOT_WEIGHTS.items():
        weight = F.when(F.col("source") == kind, F.lit(factor)).otherwise(weight)
    return F.col(score).cast("double") * weight


def flexible(
    candidates: DataFrame,
    balance: Balance,
    order: str = "seq",
    score: str = "score",
    article_id: str = "article_id",
    by_score: bool = False,
) -> DataFrame:
    """Best remaining articles by weighted score for the free slots, with their ``place``.

    The best ``free + guaranteed`` rows of all candidates are sure to hold the best ``free`` rows
    outside the guaranteed ones, so one bounded top-k replaces a sort of everything that is left.
    """
    most_free = balance.free_slots + balance.boost_slots
    most_guaranteed = sum(balance.quotas.values())
    best_first = [
        F.desc("weighted"),
        F.asc(source_ordinal(F.col("source"))),
        F.asc(order),
    ]
    pool = (
        candidates.filter(F.col("source").isin(*SOURCE_KINDS))
        .withColumn("weighted", _weighted(score))
        .orderBy(*best_first)
        .limit(most_free + most_guaranteed)
    )
    taken = guaranteed(candidates, balance, order, score if by_score else None).select(article_id)
    slots = source_quotas(candidates, balance).select("flexible").scalar()
    # At most ``most_free + most_guaranteed`` rows reach this window.
    placed = pool.join(F.broadcast(taken), article_id, "left_anti").withColumn(
        "place", F.row_number().over(Window.orderBy(*best_first))
    )
    return placed.filter((F.col("place") <= most_free) & (F.col("place") <= slots)).drop("weighted")


def select_articles(
    candidates: DataFrame,
    balance: Balance | None = None,
    order: str = "seq",
    score: str = "score",
    article_id: str = "article_id",
    *,
    by_score: bool = False,
    stage: bool = True,
) -> DataFrame:
    """Guaranteed picks in kind order, then free picks, cut at the total; adds ``position``.

    The cut may drop the picks of a later kind. Several branches read the candidates, so they are
    staged first; pass ``stage=False`` for a table that is stored already. ``by_score`` fills the
    quotas with the best articles of a kind instead of its first.
    """
    balance = balance or Balance()
    if balance.total <= 0:
        return candidates.withColumn("position", F.lit(0)).limit(0)
    if stage:
        candidates = staged(candidates)
    keys = candidates.select(
        article_id, "source", F.col(order).alias("_order"), F.col(score).alias("_score")
    )
    best_by = "_score" if by_score else None
    picks = guaranteed(keys, balance, "_order", best_by).withColumn("phase", F.lit(0))
    if balance.free_slots + balance.boost_slots > 0:
        extra = flexible(keys, balance, "_order", "_score", article_id, by_score)
        picks = picks.unionByName(extra.withColumn("phase", F.lit(1)))
    ranking = [
        F.asc("phase"),
        F.when(F.col("phase") == 0, source_ordinal(F.col("source"))),
        F.asc("place"),
    ]
    chosen = (
        picks.orderBy(*ranking)
        .limit(balance.total)
        # At most ``total`` rows reach this window.
        .withColumn("position", F.row_number().over(Window.orderBy(*ranking)))
        .select(article_id, "position")
    )
    return candidates.join(F.broadcast(chosen), article_id)
