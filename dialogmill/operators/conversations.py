"""Conversations from a table with one row per turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.operators.templates import TemplateSpec, render

TURNS_PER_PART = 1024


def messages_from_turns(turns: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """Ordered ``messages`` arrays from ``(conv_id, turn, role, text)``.

    Gives ``(conv_id, part, is_first, is_last, messages)``. A conversation is
    split into parts by turn number, ``part = turn div turns_per_part``. As
    ``(conv_id, turn)`` is a key, no group is larger than ``turns_per_part``,
    however long the conversation; an ordinary one has a single part. The first
    and last part of each conversation come from a second, narrow pass over two
    integer columns, joined on the key the arrays are already partitioned by.
    """
    part = F.expr(f"turn div {int(turns_per_part)}")
    parts = (
        turns.select("conv_id", part.alias("part"), "turn", "role", "text")
        .groupBy("conv_id", "part")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
                lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")),
            ).alias("messages")
        )
    )
    ends = (
        turns.select("conv_id", part.alias("part"))
        .groupBy("conv_id")
        .agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
        .withColumn("part", F.explode(F.array_distinct(F.array("lo", "hi"))))
        .select(
            "conv_id",
            "part",
            (F.col("part") == F.col("lo")).alias("is_first"),
            (F.col("part") == F.col("hi")).alias("is_last"),
        )
    )
    return parts.join(ends.hint("shuffle_hash"), ["conv_id", "part"], "left").select(
        "conv_id",
        "part",
        F.coalesce("is_first", F.lit(False)).alias("is_first"),
        F.coalesce("is_last", F.lit(False)).alias("is_last"),
        "messages",
    )


def render_turns(
    turns: DataFrame,
    spec: TemplateSpec,
    add_generation_prompt: bool = True,
    turns_per_part: int = TURNS_PER_PART,
) -> DataFrame:
    """``(conv_id, part, text)``; a conversation's parts, put together in order
    with nothing between, are its whole rendered text."""
    return messages_from_turns(turns, turns_per_part).select(
        "conv_id",
        "part",
        render(
            F.col("messages"), spec, add_generation_prompt, F.col("is_first"), F.col("is_last")
        ).alias("text"),
    )
