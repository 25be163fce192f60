"""Multi-party perspective rotation of conversations, with DataFrame functions only.

For every participant the dialogue is rendered with that speaker as the assistant and all others as
named users; the mask covers what the assistant says. System turns belong to no participant and
stand in every rendering. A long conversation is rendered in parts of at most ``PART`` turns, numbered over
its whole length by a range sort, so that no conversation is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.positions import number_rows
from newsloom.plans.staging import staged

PART = 256
SYSTEM = "system"
# Marks of the rendered text: fixed values of this format.
OPEN, NAMED, CLOSE, END = "<|", "user name=", "|>\n", "<|end|>\n"


def rotate(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    part: int = PART,
) -> DataFrame:
    """``conv_id, speaker, part, n_turns, text, mask, trained`` per conversation, participant and part.

    Participants are the distinct speakers other than ``system``, null and blank ones among them as
    ``unknown``. Turns are ordered by number (nulls first), then speaker, then text; repeated rows stay. A
    null text is empty. ``mask`` lists ``start:length`` of the assistant's content with its end mark, in
    characters, separated by spaces; ``trained`` is the number of such characters. A part in which the
    participant is silent has an empty mask. A conversation of system turns alone has no participant and
    gives no row. Rows without a conversation id form one conversation.
    """
    named = F.coalesce(F.nullif(F.trim(speaker), F.lit("")), F.lit("unknown"))
    rows = turns.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).alias("turn"),
        named.alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("any", F.monotonically_increasing_id())
    numbered = staged(number_rows(rows, ["conv_id", "turn", "speaker", "text", "any"], "place"))
    spans = numbered.groupBy("conv_id").agg(F.min("place").alias("first"))
    people = numbered.filter(F.col("speaker") != SYSTEM).select("conv_id", "speaker").distinct()

    same = F.col("conv_id").eqNullSafe(F.col("id"))
    placed = numbered.join(spans.withColumnRenamed("conv_id", "id"), same).drop("id")
    which = F.floor((F.col("place") - F.col("first")) / part).alias("part")
    parts = placed.groupBy("conv_id", which).agg(
        F.array_sort(F.collect_list(F.struct("place", "speaker", "text"))).alias("turns")
    )
    seats = people.select(F.col("conv_id").alias("id"), F.col("speaker").alias("me"))
    return parts.join(seats, same).select("conv_id", F.col("me").alias("speaker"), "part", *_rendered("turns", "me"))


def _rendered(turns: str, me: str) -> list[Column]:
    mine = F.col(me)

    def head(t: Column) -> Column:
        who = (
            F.when(t["speaker"] == mine, F.lit("assistant"))
            .when(t["speaker"] == SYSTEM, F.lit(SYSTEM))
            .otherwise(F.concat(F.lit(NAMED), t["speaker"]))
        )
        return F.concat(F.lit(OPEN), who, F.lit(CLOSE))

    def piece(t: Column) -> Column:
        return F.concat(head(t), t["text"], F.lit(END))

    def length(t: Column) -> Column:
        return F.length(t["text"]) + len(END)

    # One pass over lengths: where each turn starts, and the spans that are the assistant's.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(seen: Column, t: Column) -> Column:
        begin = seen["at"] + F.length(head(t))
        span = F.concat(begin.cast("string"), F.lit(":"), length(t).cast("string"))
        spans = F.when(t["speaker"] == mine, F.array_append(seen["spans"], span)).otherwise(seen["spans"])
        return F.struct((begin + length(t)).alias("at"), spans.alias("spans"))

    mask = F.aggregate(turns, start, step, lambda seen: F.array_join(seen["spans"], " "))
    own = F.filter(turns, lambda t: t["speaker"] == mine)
    trained = F.aggregate(own, F.lit(0), lambda total, t: total + length(t))
    return [
        F.size(turns).alias("n_turns"),
        F.array_join(F.transform(turns, piece), "").alias("text"),
        mask.alias("mask"),
        trained.alias("trained"),
    ]
