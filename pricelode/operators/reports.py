"""Reports over the annotated transactions (every row kept, ``anomaly_type`` null where nothing was found).

Taking all rows instead of only the findings lets a report count transactions and anomalies in the
same aggregation, so no join of the two is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode import schema
from pricelode.functions.numbers import rounded
from pricelode.functions.prices import gtn_discount
from pricelode.operators.ensemble import severity_rank
from pricelode.plans.durable import checkpointed

# Points per finding and the upper bounds of the risk tiers.
POINTS = {"high": 15, "medium": 7, "low": 2}
RULE_POINTS = 25
GREEN_UP_TO = 25
YELLOW_UP_TO = 60

PHARMACY = ["pharmacy_name", "pharmacy_chain", "state"]


def _is(severity: str) -> Column:
    return F.col("severity") == severity


def _found() -> Column:
    return F.col("anomaly_type").isNotNull()


def _is_rule() -> Column:
    return F.col("anomaly_type").isin(schema.REGULATORY_TYPES)


def _severity_counts() -> list[Column]:
    return [F.count_if(_is(s)).alias(f"{s}_count") for s in POINTS]


def pharmacy_risk(annotated: DataFrame) -> DataFrame:
    """Risk score and tier of every pharmacy with at least one anomaly, riskiest first."""
    # The names are grouping keys first: a smallest string would make Spark sort all rows, and
    # the second step sees one row per pharmacy (more only if its names vary).
    counts = ["total_anomalies", *[f"{s}_count" for s in POINTS], "regulatory_breach_count", "transactions"]
    named = annotated.groupBy("pharmacy_id", *PHARMACY).agg(
        F.count_if(_found()).alias("total_anomalies"),
        *_severity_counts(),
        F.count_if(_is_rule()).alias("regulatory_breach_count"),
        F.count("*").alias("transactions"),
    )
    counted = named.groupBy("pharmacy_id").agg(
        *[F.min(c).alias(c) for c in PHARMACY], *[F.sum(c).alias(c) for c in counts],
    ).where("total_anomalies > 0")
    points = F.col("regulatory_breach_count") * RULE_POINTS
    for severity, weight in POINTS.items():
        points = points + F.col(f"{severity}_count") * weight
    score = rounded(F.least(points / F.col("transactions") * 500, F.lit(100.0)), 1)
    tier = F.when(F.col("risk_score") <= GREEN_UP_TO, "green") \
        .when(F.col("risk_score") <= YELLOW_UP_TO, "yellow").otherwise("red")
    return (
        counted.withColumn("risk_score", score).withColumn("risk_tier", tier)
        .select(
            "pharmacy_id", "pharmacy_name", "pharmacy_chain", "state", "total_anomalies",
            F.col("high_count").alias("high_severity_count"), "regulatory_breach_count", "risk_score", "risk_tier")
        .orderBy(F.desc("risk_score"), "pharmacy_id")
    )


def commonest(counts: DataFrame, keys: list[str], value: str, n: str = "n", top: int = 1) -> DataFrame:
    """The ``top`` most frequent values per key, ties in alphabetical order."""
    order = Window.partitionBy(*keys).orderBy(F.desc(n), value)
    return counts.where(F.col(value).isNotNull()).withColumn("place", F.row_number().over(order)) \
        .where(F.col("place") <= top)


def class_summary(annotated: DataFrame) -> DataFrame:
    """Anomaly rate, mean severity, commonest violation and mean discount per drug class.

    Classes without an anomaly appear only when no class has one, with zeros.
    """
    weight = F.lit(3.0) - severity_rank()
    # One row per class and type; everything below works on those few rows.
    cells = annotated.withColumn("discount", gtn_discount(clip=True)).groupBy("drug_class", "anomaly_type").agg(
        F.count("*").alias("n"),
        F.sum(F.when(_found(), weight)).alias("weight"),
        F.sum("discount").alias("discount"), F.count("discount").alias("priced"),
    )
    found_n = F.when(_found(), F.col("n")).otherwise(0)
    per_class = cells.groupBy("drug_class").agg(
        F.sum("n").alias("transactions"), F.sum(found_n).alias("anomalies"),
        F.sum("weight").alias("weight"), F.try_divide(F.sum("discount"), F.sum("priced")).alias("avg_gtn_discount_pct"),
        # max of (count, reversed rank by name) would need the names' order; a struct of
        # negated count and name has its minimum at the commonest type, first by name.
        F.min(F.when(_found(), F.struct((-F.col("n")).alias("n"), F.col("anomaly_type")))).alias("top"),
    )
    everything = Window.partitionBy(F.lit(1))  # a row per class
    return (
        per_class.withColumn("any", F.sum("anomalies").over(everything) > 0)
        .where((F.col("anomalies") > 0) | ~F.col("any"))
        .select(
            "drug_class",
            rounded(F.col("anomalies") / F.col("transactions"), 4).alias("anomaly_rate"),
            F.coalesce(F.try_divide("weight", "anomalies"), F.lit(0.0)).alias("avg_severity_score"),
            F.col("top.anomaly_type").alias("most_common_violation"),
            "avg_gtn_discount_pct")
        .orderBy(F.desc("anomaly_rate"), "drug_class")
    )


def price_trend(df: DataFrame, days: int = 90) -> DataFrame:
    """Last price of each day within ``days`` of the drug's newest transaction (inclusive): one scan, then a row per day."""
    last = F.max(F.struct("transaction_date", "txn_id", "actual_price"))
    daily = df.groupBy("drug_id", F.to_date("transaction_date").alias("day")).agg(last.alias("last"))
    newest = F.max("last.transaction_date").over(Window.partitionBy("drug_id"))  # as many rows as the drug has days
    recent = F.col("last.transaction_date") >= F.col("newest") - F.expr(f"INTERVAL {int(days)} DAYS")
    return daily.withColumn("newest", newest).where(recent).select(
        "drug_id", "day", rounded("last.actual_price", 2).alias("actual_price"))


def drug_report(annotated: DataFrame, days: int = 90) -> DataFrame:
    """Per drug: name, severity counts, five commonest violations, the action to take and the price trend.

    ``price_trend`` maps each day within ``days`` of the drug's newest transaction to its last price, so it has at most
    ``days + 1`` entries; findings without dates and prices have an empty one. The findings themselves stay rows, see
    ``anomaly_history``. One scan.
    """
    for column, kind in (("transaction_date", "date"), ("actual_price", "double")):
        if column not in annotated.columns:
            annotated = annotated.withColumn(column, F.lit(None).cast(kind))
    day = F.to_date("transaction_date").alias("day")
    named = annotated.groupBy("drug_id", "drug_name", "anomaly_type", day).agg(
        F.count("*").alias("n"), *_severity_counts(), F.max(F.struct("transaction_date", "txn_id", "actual_price")).alias("last"))
    # At most one row per anomaly type and drug, with a list of at most one entry per name and day.
    cells = named.groupBy("drug_id", "anomaly_type").agg(
        F.min("drug_name").alias("drug_name"),
        *[F.sum(c).alias(c) for c in ("n", *[f"{s}_count" for s in POINTS])],
        F.collect_list(F.struct("day", "last")).alias("days"))
    listed = F.when(_found(), F.struct((-F.col("n")).alias("n"), "anomaly_type"))
    per_drug = cells.groupBy("drug_id").agg(
        F.min("drug_name").alias("drug_name"),
        F.sum(F.when(_found(), F.col("n")).otherwise(0)).alias("anomalies"),
        *[F.sum(f"{s}_count").alias(s) for s in POINTS],
        F.coalesce(F.max(_is_rule()), F.lit(False)).alias("has_rule"),
        F.sort_array(F.collect_list(listed)).alias("types"),
        F.sort_array(F.flatten(F.collect_list("days"))).alias("days"),
    )
    newest = F.element_at("days", -1)["last"]["transaction_date"]
    ends_day = lambda x, i: ~F.coalesce(F.get("days", i + 1)["day"] == x["day"], F.lit(False))
    recent = F.filter("days", lambda x, i: ends_day(x, i) & (
        x["last"]["transaction_date"] >= newest - F.expr(f"INTERVAL {int(days)} DAYS")))
    trend = F.map_from_entries(F.transform(recent, lambda x: F.struct(x["day"], rounded(x["last"]["actual_price"], 2))))
    action = F.when((F.col("high") > 0) & F.col("has_rule"), "regulatory_review") \
        .when(F.col("high") > 0, "escalate").when(F.col("medium") > 0, "investigate").otherwise("monitor")
    return per_drug.select(
        "drug_id", "drug_name", "anomalies",
        F.create_map(*[c for s in ("low", "medium", "high") for c in (F.lit(s), F.col(s))]).alias("severity_breakdown"),
        F.slice(F.transform("types", lambda t: t["anomaly_type"]), 1, 5).alias("top_violations"),
        action.alias("recommended_action"), trend.alias("price_trend"),
    )


def anomaly_history(annotated: DataFrame) -> DataFrame:
    """The findings as rows."""
    return annotated.where(_found())


def only(df: DataFrame, column: str, value) -> DataFrame:
    """The rows of one drug or pharmacy, for the report of a single one; an unknown id is an error."""
    rows = df.where(F.col(column) == F.lit(value))
    if rows.isEmpty():
        raise LookupError(f"{column} {value!r} not found")
    return rows


def pharmacy_profile(annotated: DataFrame) -> DataFrame:
    """Counts, commonest violation, top three drugs and the count-based tier per flagged pharmacy."""
    found = annotated.where(_found())
    breach = F.col("anomaly_type").contains("breach") | F.col("anomaly_type").contains("violation")
    # One aggregation of the findings, written once, feeds both parts of the profile.
    cells = checkpointed(found.groupBy("pharmacy_id", *PHARMACY, "drug_name", "anomaly_type").agg(
        F.count("*").alias("n"), F.count_if(_is("high")).alias("high")))
    by_type = cells.groupBy("pharmacy_id", *PHARMACY, "anomaly_type").agg(
        F.sum("n").alias("n"), F.sum("high").alias("high"))
    by_type = by_type.groupBy("pharmacy_id", "anomaly_type").agg(
        *[F.min(c).alias(c) for c in PHARMACY], F.sum("n").alias("n"), F.sum("high").alias("high"))
    per_pharmacy = by_type.groupBy("pharmacy_id").agg(
        *[F.min(c).alias(c) for c in PHARMACY],
        F.sum("n").alias("total_anomalies"), F.sum("high").alias("high_severity_count"),
        F.sum(F.when(breach, F.col("n")).otherwise(0)).alias("regulatory_breach_count"),
        F.min(F.struct((-F.col("n")).alias("n"), "anomaly_type")).alias("top"))
    drugs = commonest(
        cells.groupBy("pharmacy_id", "drug_name").agg(F.sum("n").alias("n")), ["pharmacy_id"], "drug_name", top=3)
    top_drugs = drugs.groupBy("pharmacy_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "drug_name"))), lambda d: d["drug_name"])
        .alias("top_drugs"))
    tier = F.when(F.col("high_severity_count") > 5, "red") \
        .when(F.col("high_severity_count") > 2, "yellow").otherwise("green")
    return per_pharmacy.join(top_drugs, "pharmacy_id", "left").select(
        "pharmacy_id", "pharmacy_name", "pharmacy_chain", "state", "total_anomalies", "high_severity_count",
        "regulatory_breach_count", F.col("top.anomaly_type").alias("most_common_violation"), "top_drugs",
        tier.alias("risk_tier"))


def top_anomalies(annotated: DataFrame, per_drug: int = 5) -> DataFrame:
    """The most severe findings of each drug; map tasks already cut to ``per_drug`` rows per drug."""
    order = Window.partitionBy("drug_id").orderBy(severity_rank(), F.desc("anomaly_score"), "txn_id")
    return annotated.where(_found()).withColumn("place", F.row_number().over(order)) \
        .where(F.col("place") <= per_drug)


def suggest_actions(annotated: DataFrame, actions: dict[str, str], other: str) -> DataFrame:
    """Per drug and anomaly type found on it: how often, how severe at worst, and what the caller's table of actions says."""
    cells = annotated.where(_found()).groupBy("drug_id", "anomaly_type").agg(
        F.count("*").alias("findings"), F.min(severity_rank()).alias("rank"))
    table = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    severity = F.element_at(table((v, k) for k, v in schema.SEVERITY_RANK.items()), F.col("rank"))
    action = F.coalesce(F.element_at(table(actions.items()), F.col("anomaly_type")), F.lit(other)) if actions else F.lit(other)
    return cells.select("drug_id", "anomaly_type", "findings", severity.alias("worst_severity"), action.alias("action"))
