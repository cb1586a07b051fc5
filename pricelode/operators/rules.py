"""Hard pricing rules: row-wise predicates, usable on batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode import schema

# Rule thresholds.
WAC_CAP = 2.5
ASP_CAP = 1.05
CEILING_340B = 0.855
GTN_FLOOR = 0.45
MARGIN_FLOOR = -20.0


def predicates() -> dict[str, Column]:
    """One boolean per rule, false where an input is missing; keys in order of precedence."""
    c = F.col
    rules = {
        "wac_breach": c("actual_price") > c("wac_price") * WAC_CAP,
        "asp_wac_violation": c("asp_price") > c("wac_price") * ASP_CAP,
        "340b_ceiling_breach": c("price_340b") > c("amp_price") * CEILING_340B,
        "gtn_floor_breach": c("gtn_price") < c("wac_price") * GTN_FLOOR,
        "margin_critical": c("margin_percent") < MARGIN_FLOOR,
    }
    return {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}


def with_rule_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({f"is_{name}": rule for name, rule in predicates().items()})


def violations(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per rule that fires on a row."""
    fired = F.array(*[F.when(rule, F.lit(name)) for name, rule in predicates().items()])
    return (
        df.select(*keep, F.explode(F.array_compact(fired)).alias("anomaly_type"))
        .withColumns({"detection_method": F.lit("Regulatory Rules"), "anomaly_score": F.lit(1.0)})
    )


def price_history_rules() -> dict[str, Column]:
    """Rules on a monthly price history: best price above AMP, 340B ceiling below zero."""
    rules = {
        "bp_exceeds_amp": F.col("best_price") > F.col("amp"),
        "negative_340b_ceiling": F.col("ceiling_340b") < 0,
    }
    return {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}


def annotate_price_history(df: DataFrame) -> DataFrame:
    rules = price_history_rules()
    reason = F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])
    return df.withColumns({
        "anomaly": reason.isNotNull(),
        "anomaly_reason": reason,
        "anomaly_score": F.when(reason.isNotNull(), 1.0).otherwise(0.0),
    })


def value_checks(df: DataFrame, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """``(check_name, column_name, bad_rows)`` from one scan: how many rows break each ``(check, column, predicate)``."""
    counted = df.agg(*[F.count_if(bad).alias(f"c{i}") for i, (_, _, bad) in enumerate(checks)])
    rows = [F.struct(F.lit(name).alias("check_name"), F.lit(column).alias("column_name"), F.col(f"c{i}").alias("bad_rows"))
            for i, (name, column, _) in enumerate(checks)]
    return counted.select(F.inline(F.array(*rows)))


def validate_price_history(df: DataFrame) -> DataFrame:
    """The checks of a price history. A required column that is missing counts every row; an optional one is not checked."""
    checks = [("missing", c, F.lit(True) if c not in df.columns else F.lit(False)) for c in schema.PRICE_HISTORY_REQUIRED]
    if "wac_per_unit" in df.columns:
        checks.append(("negative", "wac_per_unit", F.col("wac_per_unit") < 0))
    if "gross_to_net_pct" in df.columns:
        checks.append(("outside_0_1", "gross_to_net_pct", ~F.col("gross_to_net_pct").between(0, 1)))
    return value_checks(df, checks)


def contract_violations(df: DataFrame) -> DataFrame:
    """The checks of a transaction table."""
    gtn = F.try_divide(F.col("wac_price") - F.col("gtn_price"), F.col("wac_price"))
    return value_checks(df, [
        ("negative_wac", "wac_price", F.col("wac_price") < 0),
        ("gtn_out_of_range", "gtn_price", ~gtn.between(0, 1)),
        ("missing_key", "drug_id, pharmacy_id", F.col("drug_id").isNull() | F.col("pharmacy_id").isNull()),
    ])
