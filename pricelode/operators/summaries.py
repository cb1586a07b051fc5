"""Stored parts of the dashboard's figures: sums, counts and rank sketches that are added batch by batch and merged on read.

A batch (a day's load, say) is a partition of each table, and writing it again replaces it. Figures then come from tables of at
most drugs x days, or pharmacies x days, rows instead of the transactions. Sums, counts and distinct counts are exact; quantiles
come from KLL sketches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.functions.prices import gtn_discount, month, quarter
from pricelode.plans.durable import checkpointed, discard, freeing

#: Size of a sketch; with 800 a quantile's rank is off by at most RANK_ERROR of the rows, in 99 of 100 cases.
SKETCH_K, RANK_ERROR = 800, 0.01
SKETCHED = ("wac_price", "margin_percent", "actual_price")
AVERAGED = ("wac_price", "margin_percent", "asp_price", "amp_price", "price_340b", "gtn_pct", "gtn_clipped")
_ROWS = ("batch", "drug_id", "drug_name", "drug_class", "pharmacy_id", "severity", "anomaly_type")
_DRUGS = ("batch", "day", "drug_id", "drug_name", "drug_class", "severity", "anomaly_type")
#: Rows of one drug, day and batch are many from MANY_SAMPLED in a sample of one row in ONE_IN.
ONE_IN, MANY_SAMPLED = 1_000, 1_000


@dataclass
class Summaries:
    """``drugs`` (batch, day, drug, class, severity, type), ``pharmacies`` (batch, day, pharmacy, severity) and ``sketches``
    (batch, day, class)."""

    drugs: DataFrame
    pharmacies: DataFrame
    sketches: DataFrame


def add(annotated: DataFrame, folder: str, batch: str | Column) -> Summaries:
    """Adds a batch, or as many as the column ``batch`` has values. The input is read once; batches that are there already are
    replaced by those of the same name that have rows here, the others stay. No rows add nothing."""
    name = F.lit(batch) if isinstance(batch, str) else batch
    values = {c: F.col(c) for c in {*AVERAGED, *SKETCHED} - {"gtn_pct", "gtn_clipped"}}
    values |= {"gtn_pct": gtn_discount(scale=100.0), "gtn_clipped": gtn_discount(scale=100.0, clip=True)}
    rows = checkpointed(annotated.withColumn("batch", name.cast("string")).select(
        *_ROWS, F.to_date("transaction_date").alias("day"), *(c.alias(n) for n, c in values.items())))
    sums = [x for c in AVERAGED for x in (F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n"))]
    ranked = [x for c in SKETCHED for x in (
        F.kll_sketch_agg_double(c, SKETCH_K).alias(f"{c}_ranks"), F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high"), F.count(c).alias(f"{c}_n"))]
    tables = {
        "drugs": _by_drug(rows, [F.count("*").alias("n"), *sums]),
        # Files of a batch are of even size: a batch of many rows is dealt over many tasks.
        "pharmacies": rows.groupBy("batch", "day", "pharmacy_id", "severity").agg(F.count("*").alias("n")).hint("rebalance", "batch"),
        "sketches": rows.groupBy("batch", "day", "drug_class").agg(*ranked).hint("rebalance", "batch")}
    spark = annotated.sparkSession
    for table, parts in tables.items():
        with freeing(spark):
            parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder.rstrip('/')}/{table}")
    discard(rows)
    return Summaries(*(spark.read.schema(parts.schema).parquet(f"{folder.rstrip('/')}/{t}") for t, parts in tables.items()))


def _by_drug(rows: DataFrame, sums: list[Column]) -> DataFrame:
    """``sums`` per group of ``_DRUGS``, in parts of even size that hold few batches each.

    Most groups have few rows: these go to the task of their range as they are, once, as sums of each task would be about as many,
    and wider. Only the rows of drugs with many on a day are summed in each task first (a sample picks the route, both give the same)."""
    near = ["batch", "day", "drug_id"]
    sampled = rows.select(*near).where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(ONE_IN)) == 0)
    many = checkpointed(sampled.groupBy(*near).agg(F.count("*").alias("_n")).where(F.col("_n") >= MANY_SAMPLED).select(
        *[F.col(c).alias(f"_{c}") for c in near]))
    if many.isEmpty():
        discard(many)
        return rows.repartitionByRange(*near).groupBy(*_DRUGS).agg(*sums)
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in near]
    few, crowded = (rows.join(F.broadcast(many), match, how) for how in ("left_anti", "left_semi"))  # a key per million rows at most
    return few.repartitionByRange(*near).groupBy(*_DRUGS).agg(*sums).unionByName(crowded.groupBy(*_DRUGS).agg(*sums))


def load(spark: SparkSession, folder: str) -> Summaries:
    """All batches of a folder; it is an error if there is none with rows."""
    try:
        return Summaries(*(spark.read.parquet(f"{folder.rstrip('/')}/{t}") for t in ("drugs", "pharmacies", "sketches")))
    except AnalysisException as missing:
        raise FileNotFoundError(f"no summaries at {folder}: add a batch first") from missing


def mean(column: str) -> Column:
    return F.try_divide(F.sum(f"{column}_sum"), F.sum(f"{column}_n"))


def _findings(parts: Summaries) -> DataFrame:
    return parts.drugs.where("anomaly_type IS NOT NULL")


def kpis(parts: Summaries) -> DataFrame:
    both = parts.drugs.unionByName(parts.pharmacies.select("pharmacy_id"), allowMissingColumns=True)  # without their numbers
    high = F.sum(F.when(F.col("severity") == "high", F.col("n")))
    found = F.sum(F.when(F.col("anomaly_type").isNotNull(), F.col("n")).otherwise(0))
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("transactions"), F.count_distinct("drug_id").alias("drugs"),
        F.count_distinct("pharmacy_id").alias("pharmacies"), mean("wac_price").alias("avg_wac"),
        mean("margin_percent").alias("avg_margin"), F.try_divide(found * F.lit(100.0), F.sum("n")).alias("anomaly_rate"),
        F.coalesce(high, F.lit(0)).alias("high_severity"))


def counts_by(parts: Summaries, column: str, n: int | None = None) -> DataFrame:
    """Findings by severity, type, class or drug; the ``n`` most frequent if that is given, ties in alphabetical order."""
    counts = _findings(parts).groupBy(column).agg(F.sum("n").alias("n"))
    return counts if n is None else counts.orderBy(F.desc("n"), column).limit(n)


def timeline(parts: Summaries) -> DataFrame:
    return _findings(parts).groupBy(month("day").alias("month"), "severity").agg(F.sum("n").alias("n"))


def wac_trend(parts: Summaries, top: int = 8) -> DataFrame:
    """Monthly mean WAC of the drugs with most transactions."""
    chosen = parts.drugs.groupBy("drug_name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "drug_name").limit(top)
    return parts.drugs.join(F.broadcast(chosen.select("drug_name")), "drug_name", "left_semi").groupBy(
        month("day").alias("month"), "drug_name").agg(mean("wac_price").alias("wac_price"))


def gtn_by_quarter(parts: Summaries) -> DataFrame:
    return parts.drugs.groupBy("drug_class", quarter("day").alias("quarter")).agg(mean("gtn_pct").alias("gtn_pct"))


def gtn_by_month(parts: Summaries) -> DataFrame:
    return parts.drugs.groupBy("drug_class", month("day").alias("month")).agg(mean("gtn_clipped").alias("gtn_pct"))


def benchmarks_long(parts: Summaries) -> DataFrame:
    names = ["wac_price", "asp_price", "amp_price", "price_340b"]
    return parts.drugs.groupBy("drug_class").agg(*(mean(c).alias(c) for c in names)).unpivot(["drug_class"], names, "benchmark", "avg_price")


def five_numbers(parts: Summaries, value: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Minimum, quartiles and maximum per class, over the days from ``since`` to ``until`` if they are given. The ends are exact,
    the ranks of the quartiles off by at most RANK_ERROR."""
    if value not in SKETCHED:
        raise ValueError(f"{value} is not sketched: expected one of {', '.join(SKETCHED)}")
    days = parts.sketches
    days = days if since is None else days.where(F.col("day") >= F.lit(since).cast("date"))
    days = days if until is None else days.where(F.col("day") <= F.lit(until).cast("date"))
    merged = days.where(F.col(f"{value}_n") > 0).groupBy("drug_class").agg(
        F.kll_merge_agg_double(f"{value}_ranks", SKETCH_K).alias("ranks"), F.min(f"{value}_low").alias("low"), F.max(f"{value}_high").alias("high"))
    quartiles = [F.kll_sketch_get_quantile_double("ranks", F.lit(p)).alias(c) for c, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]
    return merged.select("drug_class", "low", *quartiles, "high")
