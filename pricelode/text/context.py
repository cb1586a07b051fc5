"""Packing ranked passages into a context of limited length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_CHARS = 6_000
SEPARATOR = "\n\n---\n\n"


def packed_parts(
    ranked: DataFrame, by: str = "query_id", order: str = "place",
    text: str = "text", topic: str = "topic", title: str = "title", budget: int = MAX_CHARS,
) -> DataFrame:
    """Passages in order until ``budget`` characters are used; the one that crosses it is cut."""
    # The list of one ``by`` value is k hits of a search, or the chunks of a single document.
    before = F.coalesce(
        F.sum(F.length(text)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))
    left = (F.lit(budget) - F.col("used")).cast("int")
    named = F.coalesce(F.col(title), F.lit("")) != ""
    header = F.concat(
        F.lit("["), F.coalesce(F.col(topic), F.lit("")), F.when(named, F.concat(F.lit(" — "), F.col(title)))
        .otherwise(F.lit("")), F.lit("]"))
    return ranked.withColumn("used", before).where(F.col("used") < budget) \
        .withColumns({"header": header, "body": F.substr(F.col(text), F.lit(1), left)})


def context_pack(ranked: DataFrame, by: str = "query_id", order: str = "place", **options) -> DataFrame:
    """One context per ``by`` value: header and body of each passage, joined by a separator."""
    parts = packed_parts(ranked, by, order, **options)
    block = F.concat(F.col("header"), F.lit("\n"), F.col("body"))
    return parts.groupBy(by).agg(
        F.count("*").alias("passages"), F.sum(F.length("body")).alias("body_chars"),
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))).alias("blocks"),
    ).withColumn("context", F.array_join(F.transform("blocks", lambda x: x["b"]), SEPARATOR)).drop("blocks")
