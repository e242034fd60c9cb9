"""Conversation windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import thresholds as T
from .ordering import running_sum, top_per_key


def conversation_window(messages: DataFrame, rounds: int = T.WINDOW_ROUNDS) -> DataFrame:
    """System rows plus the last `rounds` rounds. Read in the order (conv_id, segment, turn):
    an untrimmed conversation keeps its order, a trimmed one has its system rows first."""
    keep = rounds * 2
    dialogue = messages.where(F.col("role") != "system")
    counts = dialogue.groupBy("conv_id").agg((F.count(F.lit(1)) > keep).alias("trimmed"))
    latest = top_per_key(dialogue, ["conv_id"], [F.desc("turn")], keep).drop("_rank")
    kept = latest.unionByName(messages.where(F.col("role") == "system")).join(counts, "conv_id", "left")
    kept = kept.withColumn("trimmed", F.coalesce("trimmed", F.lit(False)))
    return kept.withColumn("segment", (F.col("trimmed") & (F.col("role") != "system")).cast("int"))


def summary_triggers(messages: DataFrame, threshold: int = T.WINDOW_ROUNDS, bucket: Column | None = None) -> DataFrame:
    """After every turn: dialogue messages so far, and whether a summary is due."""
    spoken = F.col("role").isin("user", "assistant").cast("long")
    counted = running_sum(messages, ["conv_id"], [F.col("turn")], bucket, spoken, "dialogue_count")
    return counted.withColumn("summary_due", F.col("dialogue_count") % (2 * threshold) == 0)


def session_turns(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("turns"))
