"""Monthly price history per drug and what is derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.functions.prices import REBATE_INNOVATOR, ceiling_340b, gtn_discount, month


def price_history(df: DataFrame, rebate: float = REBATE_INNOVATOR) -> DataFrame:
    """One row per drug (with its name) and month."""
    monthly = df.groupBy(
        F.col("drug_id").alias("ndc"), F.col("drug_name").alias("brand_name"), month().alias("period"),
    ).agg(
        F.avg("wac_price").alias("wac_per_unit"), F.avg("asp_price").alias("asp"), F.avg("amp_price").alias("amp"),
        F.min("actual_price").alias("best_price"), F.avg("gtn_price").alias("net_price"))
    return monthly.withColumns({
        "ceiling_340b": ceiling_340b("amp", rebate),
        "gross_to_net_pct": gtn_discount("wac_per_unit", "net_price"),
    })


def history_of(history: DataFrame, identifier: str) -> DataFrame:
    """The history of one drug, by name or code, oldest first."""
    rows = history.where((F.col("brand_name") == identifier) | (F.col("ndc").cast("string") == identifier))
    if rows.isEmpty():
        raise LookupError(f"no price history for {identifier!r}")
    return rows.orderBy("ndc", "period")


def gtn_waterfall(df: DataFrame, deductions: dict[str, Column]) -> DataFrame:
    """Mean WAC, each named deduction and the net price per drug, in long form."""
    steps = {"wac": F.col("wac_price"), **deductions, "net": F.col("gtn_price")}
    means = df.groupBy("drug_id").agg(*[F.avg(c).alias(name) for name, c in steps.items()])
    return means.unpivot(["drug_id"], list(steps), "step", "amount")


def competitors(df: DataFrame) -> DataFrame:
    """Mean price and share of transactions of each manufacturer within its drug class."""
    cells = df.groupBy(F.col("drug_class").alias("therapeutic_area"), F.col("manufacturer").alias("competitor_brand")) \
        .agg(F.avg("wac_price").alias("competitor_wac"), F.count("*").alias("n"),
             F.max("transaction_date").alias("snapshot_date"))
    area = cells.groupBy("therapeutic_area").agg(F.sum("n").alias("area_n"))
    return cells.join(area, "therapeutic_area").select(
        "therapeutic_area", "competitor_brand", "competitor_wac",
        (F.col("n") / F.col("area_n") * 100).alias("market_share_pct"), "snapshot_date")


def competitive_snapshot(competitors: DataFrame, therapeutic_area: str | None = None) -> DataFrame:
    return competitors if therapeutic_area is None else \
        competitors.where(F.col("therapeutic_area") == therapeutic_area)
