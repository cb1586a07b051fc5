"""Message histories: one row per (conv_id, turn)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history_tail(messages: DataFrame, last: int = 6) -> DataFrame:
    """The newest ``last`` messages of each conversation."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= last).drop("_r")


def conversation_summary(messages: DataFrame, preview: int = 100) -> DataFrame:
    """User turns, the last user message and the start of the last assistant message."""
    def last(role: str):
        return F.max(F.when(F.col("role") == role, F.struct("turn", "text")))["text"]

    return messages.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("total_turns"),
        F.coalesce(last("user"), F.lit("")).alias("last_user_message"),
        F.coalesce(F.substring(last("assistant"), 1, preview), F.lit("")).alias("last_assistant_preview"))
