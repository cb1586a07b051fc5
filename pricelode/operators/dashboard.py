"""Dashboard and exploration aggregates over transactions and findings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.functions.formats import anomaly_label
from pricelode.functions.numbers import rounded
from pricelode.functions.prices import gtn_discount, month, quarter
from pricelode.operators.ensemble import severity_rank
from pricelode.plans.quantiles import exact_quantiles, profile, quantile_table

BENCHMARKS = ["wac_price", "asp_price", "amp_price", "price_340b"]
CORRIDOR = ["wac_price", "asp_price", "amp_price", "gtn_price", "price_340b"]


def _rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def kpis(annotated: DataFrame) -> DataFrame:
    found = F.count_if(F.col("anomaly_type").isNotNull())
    return annotated.agg(
        F.count("*").alias("transactions"),
        F.count_distinct("drug_id").alias("drugs"),
        F.count_distinct("pharmacy_id").alias("pharmacies"),
        F.avg("wac_price").alias("avg_wac"),
        F.avg("margin_percent").alias("avg_margin"),
        _rate(found, F.count("*")).alias("anomaly_rate"),
        F.count_if(F.col("severity") == "high").alias("high_severity"),
    )


def top_values(df: DataFrame, value: str, n: int, name: str = "n") -> DataFrame:
    """The ``n`` most frequent values, ties in alphabetical order."""
    return df.groupBy(value).agg(F.count("*").alias(name)).orderBy(F.desc(name), value).limit(n)


def wac_trend(df: DataFrame, top: int = 8) -> DataFrame:
    """Monthly mean WAC of the drugs with most transactions."""
    # One aggregation serves both: counts pick the drugs, sums and counts give the means.
    cells = df.groupBy("drug_name", month().alias("month")).agg(
        F.count("*").alias("n"), F.sum("wac_price").alias("total"), F.count("wac_price").alias("priced"))
    chosen = cells.groupBy("drug_name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "drug_name").limit(top)
    return cells.join(F.broadcast(chosen.select("drug_name")), "drug_name", "left_semi").select(
        "month", "drug_name", F.try_divide("total", "priced").alias("wac_price"))


def gtn_by_quarter(df: DataFrame) -> DataFrame:
    return df.groupBy("drug_class", quarter().alias("quarter")).agg(
        F.avg(gtn_discount(scale=100.0)).alias("gtn_pct"))


def gtn_by_month(df: DataFrame) -> DataFrame:
    return df.groupBy("drug_class", month().alias("month")).agg(
        F.avg(gtn_discount(scale=100.0, clip=True)).alias("gtn_pct"))


def pivoted(long: DataFrame, period: str, values: list[str] | None = None, fill: float | None = None) -> DataFrame:
    """One row per class, one column per period; the long form is already aggregated."""
    wide = long.groupBy("drug_class").pivot(period, values).agg(F.max("gtn_pct"))
    return wide if fill is None else wide.fillna(fill)


def benchmarks_long(df: DataFrame) -> DataFrame:
    means = df.groupBy("drug_class").agg(*[F.avg(c).alias(c) for c in BENCHMARKS])
    return means.unpivot(["drug_class"], BENCHMARKS, "benchmark", "avg_price")


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def five_numbers(df: DataFrame, value: str, by: str = "drug_class") -> DataFrame:
    """Minimum, quartiles and maximum per class, for any number of classes."""
    found = quantile_table(df, by, [value], [0.0, 0.25, 0.5, 0.75, 1.0])
    return found.select(by, *[F.get("quantiles", F.lit(i)).alias(c) for i, c in enumerate(("low", "q1", "median", "q3", "high"))])


def method_coverage(results: DataFrame) -> DataFrame:
    return results.select(F.explode("methods").alias("method")).groupBy("method").agg(F.count("*").alias("n"))


def timeline(results: DataFrame) -> DataFrame:
    return results.groupBy(month().alias("month"), "severity").agg(F.count("*").alias("n"))


def explore(
    results: DataFrame,
    severities: Iterable[str] = (), types: Iterable[str] = (), drug_name: str | None = None,
) -> DataFrame:
    """Findings by severity, type and drug; an empty choice does not filter."""
    severities, types = list(severities), list(types)
    if severities:
        results = results.where(F.col("severity").isin(severities))
    if types:
        results = results.where(F.col("anomaly_type").isin(types))
    if drug_name is not None:
        results = results.where(F.col("drug_name") == drug_name)
    return results


def explorer_table(results: DataFrame) -> DataFrame:
    return results.select(
        "txn_id", "drug_name", "drug_class", "pharmacy_name", "state", "anomaly_type", "severity", "detection_method",
        "anomaly_score", "description", "recommended_action", "transaction_date",
    ).orderBy(severity_rank(), F.desc("anomaly_score"), "txn_id")


def filter_options(results: DataFrame, column: str) -> DataFrame:
    return results.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def scatter_bounds(results: DataFrame) -> DataFrame:
    """Points of the WAC and actual price plot and the end of its diagonal."""
    return results.agg(
        F.count("*").alias("points"),
        F.greatest(F.max("wac_price"), F.max("actual_price")).alias("axis_end"))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, one row per column."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counted.unpivot([], df.columns, "column_name", "nulls")


def drug_catalog(df: DataFrame) -> DataFrame:
    # Attributes are grouping keys first, so that the pass over all rows hashes instead of sorting.
    cells = df.groupBy("drug_name", "drug_class", "manufacturer", "drug_id").agg(
        F.min("wac_price").alias("low"), F.max("wac_price").alias("high"),
        F.sum("wac_price").alias("total"), F.count("wac_price").alias("priced"))
    return cells.groupBy("drug_name").agg(
        *[F.min(c).alias(c) for c in ("drug_class", "manufacturer", "drug_id")],
        F.min("low").alias("wac_min"), F.max("high").alias("wac_max"),
        F.try_divide(F.sum("total"), F.sum("priced")).alias("wac_mean"))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, standard deviation, extremes and quartiles, one row per column."""
    known = profile(df, cols)
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75], known)
    rows = [
        (c, known[c].n, known[c].mean, known[c].std, known[c].low, *quartiles[c], known[c].high) for c in cols
    ]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, n long, mean double, std double, low double, "
              "q1 double, median double, q3 double, high double")


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Counts in all equal-width bins from the smallest to the largest finite value, the last bin closed."""
    data = df.select(value.cast("double").alias("v")).where(F.abs("v") < float("inf"))
    ends = data.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if ends["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    low, width = ends["lo"], (ends["hi"] - ends["lo"]) / bins or 1.0
    bin_no = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    counted = data.groupBy(bin_no.alias("bin")).agg(F.count("*").alias("n"))
    return every.join(counted, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def gtn_center(df: DataFrame) -> DataFrame:
    """Mean and median gross-to-net discount in percent."""
    pct = df.select(gtn_discount(scale=100.0, clip=True).alias("pct"))
    known = profile(pct, ["pct"])
    median = exact_quantiles(pct, ["pct"], [0.5], known)["pct"][0]
    return df.sparkSession.createDataFrame([(known["pct"].mean, median)], "mean_gtn double, median_gtn double")


def class_pricing(df: DataFrame) -> DataFrame:
    return df.groupBy("drug_class").agg(
        rounded(F.avg("wac_price"), 2).alias("wac_mean"),
        rounded(F.min("wac_price"), 2).alias("wac_min"),
        rounded(F.max("wac_price"), 2).alias("wac_max"),
        rounded(F.avg("gtn_price"), 2).alias("gtn_mean"),
        rounded(F.avg("margin_percent"), 2).alias("margin_mean"))


def key_findings(df: DataFrame) -> DataFrame:
    known = profile(df, ["margin_percent"])
    median = exact_quantiles(df, ["margin_percent"], [0.5], known)["margin_percent"][0]
    labelled = F.count_if(F.col("is_anomaly"))
    # The dearest drug is the first by name among those that reach the highest WAC.
    tops = df.groupBy("drug_name").agg(F.max("wac_price").alias("top"))
    dearest = tops.where("top is not null").orderBy(F.desc("top"), "drug_name").first()
    return df.agg(
        F.count("*").alias("transactions"),
        F.count_distinct("drug_name").alias("drugs"),
        F.count_distinct("pharmacy_name").alias("pharmacies"),
        labelled.alias("anomalies"),
        _rate(labelled, F.count("*")).alias("anomaly_rate"),
        F.avg("wac_price").alias("avg_wac"),
        F.avg("gtn_price").alias("avg_gtn"),
        F.lit(median).cast("double").alias("median_margin"),
        F.lit(dearest and dearest["drug_name"]).cast("string").alias("highest_wac_drug"),
        F.max("wac_price").alias("highest_wac"),
    )


def summary_stats(df: DataFrame) -> DataFrame:
    """Totals of the labelled table with the five drugs that have most labelled anomalies."""
    labelled = F.col("is_anomaly")
    top = [r["drug_name"] for r in top_values(df.where(labelled), "drug_name", 5).collect()]
    return df.agg(
        F.count("*").alias("total_records"),
        F.count_if(labelled).alias("anomaly_count"),
        rounded(F.try_divide(F.count_if(labelled), F.count("*")), 4).alias("anomaly_rate"),
        rounded(F.avg("margin_percent"), 4).alias("avg_margin"),
        rounded(F.avg(gtn_discount()), 4).alias("avg_gtn_discount_pct"),
    ).withColumn("top_5_anomalous_drugs", F.array(*[F.lit(name) for name in top]).cast("array<string>"))


def wac_range(df: DataFrame) -> DataFrame:
    return df.groupBy("drug_class").agg(
        rounded(F.min("wac_price"), 2).alias("wac_min"),
        rounded(F.max("wac_price"), 2).alias("wac_max"),
        rounded(F.avg("wac_price"), 2).alias("wac_mean"))


def label_counts(df: DataFrame) -> DataFrame:
    """Labelled anomalies and normal rows by label type."""
    return df.groupBy(anomaly_label(F.col("is_anomaly")).alias("status"), "anomaly_type").agg(F.count("*").alias("n"))


def label_overlap(annotated: DataFrame) -> DataFrame:
    """Detector findings against the labels of the source."""
    return annotated.groupBy(
        F.col("is_anomaly").alias("labelled"), F.col("anomaly_type").isNotNull().alias("found"),
    ).agg(F.count("*").alias("n"))


def top_abs_margin(df: DataFrame, n: int = 10) -> DataFrame:
    return df.where("is_anomaly").orderBy(F.desc(F.abs("margin_percent")), "txn_id").limit(n).select(
        "txn_id", "drug_name", "pharmacy_name", "wac_price", "actual_price", "margin_percent")


def most_expensive(df: DataFrame, top: int = 5) -> DataFrame:
    """All transactions of the drugs with the highest WAC."""
    dearest = df.groupBy("drug_name").agg(F.max("wac_price").alias("m")).orderBy(F.desc("m"), "drug_name").limit(top)
    return df.join(F.broadcast(dearest.select("drug_name")), "drug_name", "left_semi").select(
        "txn_id", "drug_name", "transaction_date", "wac_price")


def price_corridor(df: DataFrame, drug_name: str | None = None) -> DataFrame:
    """Five benchmark prices by date in long form, for one drug or all."""
    rows = df if drug_name is None else df.where(F.col("drug_name") == drug_name)
    return rows.select("txn_id", "drug_name", "transaction_date", *CORRIDOR).unpivot(
        ["txn_id", "drug_name", "transaction_date"], CORRIDOR, "benchmark", "price")
