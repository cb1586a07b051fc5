"""Every registered query: operators of the package applied to the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelode.functions import formats, prices
from pricelode.functions.numbers import rounded
from pricelode.operators import (
    causal, conversations, dashboard, ensemble, fitted, forest, history, lof, reports, rules, statistical, summaries, timeseries)
from pricelode.plans.durable import discard, scratch_path
from pricelode.plans.quantiles import profile
from pricelode.sources import adhoc, tables
from pricelode.sources.tpch import pricing_fact, spread_table, table
from pricelode.text import context, embed, lsh, pruned, retrieval, search
from pricelode.text.chunk import chunk_documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounded numbers and dates and lists as text, so that two engines print the same values."""
    def tidy(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            return F.coalesce(rounded(c, digits), c).alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return formats.iso_date(c).alias(field.name)
        if isinstance(field.dataType, T.ArrayType):
            return F.array_join(c, ",").alias(field.name)
        return c
    return df.select(*[tidy(f) for f in df.schema.fields])


def query(digits: int = 6):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, folder: plain(fn(spark, folder), digits)
        return fn
    return register


def on_fact(digits: int = 6):
    """A query over the transactions."""
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, folder: plain(fn(pricing_fact(spark, folder)), digits)
        return fn
    return register


def on_annotated(digits: int = 6):
    """A query over the transactions annotated by the detectors that SQL can express."""
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, folder: plain(
            fn(ensemble.annotate(ensemble.with_flags(pricing_fact(spark, folder)))), digits)
        return fn
    return register


def on_results(digits: int = 6):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, folder: plain(
            fn(ensemble.results(ensemble.annotate(ensemble.with_flags(pricing_fact(spark, folder))))), digits)
        return fn
    return register


# Sources and sinks

@on_fact()
def scan_pricing(fact):
    return tables.prepared(fact)


@query()
def roundtrip_parquet(spark, folder):
    path = tables.save(pricing_fact(spark, folder), scratch_path(spark, "pricing"))
    return tables.scan_pricing(spark, path).select("txn_id", "drug_name", "actual_price", "transaction_date")


@on_fact()
def star_drugs(fact):
    return tables.star_schema(fact)["drugs"]


@on_fact()
def star_pharmacies(fact):
    return tables.star_schema(fact)["pharmacies"]


@on_fact()
def star_anomalies(fact):
    return tables.star_schema(fact)["anomalies"]


@on_fact()
def anomaly_extract(fact):
    return tables.labelled_anomalies(fact)


@on_fact()
def star_join(fact):
    return tables.star_join(tables.star_schema(fact)).select(
        "tx_id", "drug_id", "drug_name", "drug_class", "pharmacy_id", "pharmacy_name", "state", "actual_price")


ADHOC = """
    SELECT d.drug_class, p.state, count(*) AS n, avg(t.margin_percent) AS avg_margin
    FROM transactions t
    JOIN drugs d ON t.drug_id = d.drug_id
    JOIN pharmacies p ON t.pharmacy_id = p.pharmacy_id
    GROUP BY d.drug_class, p.state
    ORDER BY n DESC, d.drug_class, p.state
"""


@query()
def adhoc_sql(spark, folder):
    return adhoc.query(spark, ADHOC, tables.star_schema(pricing_fact(spark, folder)))


# Projections, filters, predicates

@on_results()
def explorer_filter(found):
    return dashboard.explorer_table(
        dashboard.explore(found, ["high", "medium"], ["wac_breach", "mom_spike", "mom_drop"])).drop("description")


@on_fact()
def price_trend_90d(fact):
    return reports.price_trend(fact)


@on_fact()
def gtn_discount(fact):
    g = prices.gtn_discount
    return fact.select(
        "txn_id", g(clip=True).alias("fraction_clipped"), g().alias("fraction"),
        g(scale=100.0).alias("percent"), g(scale=100.0, clip=True).alias("percent_clipped"))


@on_fact()
def margin(fact):
    return fact.select("txn_id", prices.margin_percent().alias("margin"))


@on_fact()
def rule_flags(fact):
    return rules.with_rule_flags(fact).select("txn_id", *[f"is_{n}" for n in rules.predicates()])


@on_fact()
def validate_contract(fact):
    return rules.contract_violations(fact).drop("column_name")


@on_results()
def scatter_bounds(found):
    return dashboard.scatter_bounds(found)


@on_fact()
def null_counts(fact):
    return dashboard.null_counts(fact)


@on_fact()
def format_cols(fact):
    return fact.select(
        "txn_id", formats.usd(F.col("actual_price")).alias("usd"),
        formats.pct(F.col("volume_units") / 1000).alias("pct"),
        formats.iso_date(F.col("transaction_date")).alias("day"),
        formats.anomaly_label(F.col("is_anomaly")).alias("status"))


# Reports

@on_annotated()
def pharmacy_risk(annotated):
    return reports.pharmacy_risk(annotated)


@on_annotated(4)
def class_summary(annotated):
    return reports.class_summary(annotated)


@on_annotated()
def drug_report(annotated):
    report = reports.drug_report(annotated)
    return report.select(
        "drug_id", "drug_name", "anomalies", *[F.col("severity_breakdown")[s].alias(s) for s in ("low", "medium", "high")],
        "top_violations", "recommended_action",
        F.transform(F.map_entries("price_trend"), lambda e: F.concat_ws(
            "=", e["key"].cast("string"), F.format_string("%.2f", e["value"]))).alias("price_trend"))


@on_fact()
def summary_stats(fact):
    return dashboard.summary_stats(fact)


@on_fact()
def wac_range_by_class(fact):
    return dashboard.wac_range(fact)


@on_annotated(4)
def kpis(annotated):
    return dashboard.kpis(annotated)


@on_fact(4)
def wac_trend_top8(fact):
    return dashboard.wac_trend(fact)


@on_fact(4)
def gtn_quarter(fact):
    return dashboard.gtn_by_quarter(fact)


@on_fact(4)
def gtn_month_pivot(fact):
    """The filled pivot, turned back to long form for its many columns."""
    wide = dashboard.pivoted(dashboard.gtn_by_month(fact), "month", fill=0.0)
    months = [c for c in wide.columns if c != "drug_class"]
    return wide.unpivot(["drug_class"], [f"`{m}`" for m in months], "month", "gtn_pct")


@on_fact(4)
def benchmarks_long(fact):
    return dashboard.benchmarks_long(fact)


@on_results()
def severity_counts(found):
    return dashboard.counts_by(found, "severity")


@on_results()
def type_counts(found):
    return dashboard.counts_by(found, "anomaly_type")


@on_results()
def top_drugs(found):
    return dashboard.top_values(found, "drug_name", 10)


@on_fact()
def margin_box(fact):
    return dashboard.five_numbers(fact, "margin_percent")


@on_fact()
def wac_box(fact):
    return dashboard.five_numbers(fact, "wac_price")


@on_fact()
def wac_box_by_drug(fact):
    return dashboard.five_numbers(fact, "actual_price", "drug_id")


@on_results()
def method_coverage(found):
    return dashboard.method_coverage(found)


@on_results()
def anomaly_timeline(found):
    return dashboard.timeline(found)


@on_fact(4)
def drug_catalog(fact):
    return dashboard.drug_catalog(fact)


@on_fact(4)
def describe_wac(fact):
    return dashboard.describe(dashboard.drug_catalog(fact), ["wac_min", "wac_max", "wac_mean"])


@on_fact()
def class_counts(fact):
    return dashboard.counts_by(dashboard.drug_catalog(fact), "drug_class")


@on_fact()
def manufacturer_counts(fact):
    return dashboard.top_values(dashboard.drug_catalog(fact), "manufacturer", 10)


@on_fact(4)
def gtn_histogram(fact):
    return dashboard.histogram(fact, prices.gtn_discount(scale=100.0, clip=True), 30)


@on_fact(4)
def wac_histogram(fact):
    return dashboard.histogram(dashboard.drug_catalog(fact), F.col("wac_mean"), 20)


@on_fact(4)
def gtn_center(fact):
    return dashboard.gtn_center(fact)


@on_fact()
def class_pricing(fact):
    return dashboard.class_pricing(fact)


@on_fact(4)
def key_findings(fact):
    return dashboard.key_findings(fact)


@on_annotated()
def pharmacy_profile(annotated):
    return reports.pharmacy_profile(annotated)


@query()
def conversation_summary(spark, folder):
    return conversations.conversation_summary(table(spark, folder, "conversations"))


@on_fact()
def top_abs_margin(fact):
    return dashboard.top_abs_margin(fact)


@on_fact()
def top5_expensive(fact):
    return dashboard.most_expensive(fact)


@on_fact()
def price_corridor(fact):
    return dashboard.price_corridor(fact)


@on_fact()
def label_counts(fact):
    return dashboard.label_counts(fact)


@on_annotated()
def label_overlap(annotated):
    return dashboard.label_overlap(annotated)


@on_annotated()
def suggest_action(annotated):
    ruled = ("wac_breach", "asp_wac_violation", "340b_ceiling_breach", "gtn_floor_breach")
    return reports.suggest_actions(annotated, {"margin_critical": "team-b"} | dict.fromkeys(ruled, "team-a"), "queue")



# Ordered operators

@on_fact()
def mom_change(fact):
    return timeseries.price_changes(fact).select("txn_id", "previous_price", "price_change")


@on_fact(4)
def causal_summary(fact):
    return causal.causal_summary(fact)


@on_annotated()
def anomaly_history(annotated):
    return reports.anomaly_history(annotated).select(
        "drug_id", "txn_id", "anomaly_type", "severity", "detection_method", "anomaly_score")


@on_results()
def filter_options(found):
    return dashboard.filter_options(found, "anomaly_type")


@on_annotated()
def anomaly_top5(annotated):
    return reports.top_anomalies(annotated).select(
        "drug_id", "place", "txn_id", "drug_name", "anomaly_type", "severity", "anomaly_score",
        "recommended_action", "transaction_date", "wac_price", "actual_price", "margin_percent")


@query()
def history_tail(spark, folder):
    return conversations.history_tail(table(spark, folder, "conversations"))


@on_fact(4)
def zscore_rolling(fact):
    return timeseries.rolling_zscore(fact).select("txn_id", "rolling_mean", "z", "is_spike")


@on_fact()
def volume_outlier(fact):
    return timeseries.volume_outliers(fact, sigmas=1.5).select("txn_id", "drug_id", "volume_units")


# Detectors

@on_fact()
def zscore(fact):
    z = statistical.ZScore.fit(fact)
    return fact.withColumns(z.columns()).where(z.flagged()).select(
        "txn_id", "z_feature", "z_max", z.score().alias("anomaly_score"))


@on_fact()
def iqr(fact):
    fence = statistical.IqrFence.fit(fact)
    return fact.withColumns(fence.columns()).where(fence.flagged()).select(
        "txn_id", "iqr_feature", "iqr_distance", fence.score().alias("anomaly_score"))


@on_fact()
def mom(fact):
    return timeseries.mom_flags(fact).where("mom_type is not null").select(
        "txn_id", F.col("mom_type").alias("anomaly_type"), F.col("mom_score").alias("anomaly_score"))


@on_fact()
def mom_hot(fact):
    # The hot route writes its rows: only the columns that the moves need.
    fact = fact.select("txn_id", "drug_id", "pharmacy_id", "transaction_date", "actual_price")
    rows = timeseries.mom_flags(fact, one_in=1, min_sampled=3)
    return rows.where("mom_type is not null").select(
        "txn_id", F.col("mom_type").alias("anomaly_type"), F.col("mom_score").alias("anomaly_score"))


@on_fact(4)
def zscore_rolling_hot(fact):
    fact = fact.select("txn_id", "drug_id", "transaction_date", "actual_price")
    rows = timeseries.rolling_zscore(fact, one_in=1, min_sampled=20)
    return rows.select("txn_id", "rolling_mean", "z", "is_spike")


@on_fact()
def regulatory(fact):
    return rules.violations(fact, ["txn_id"])


@on_fact()
def iforest(fact):
    rows = ensemble.checkpointed(fact.select("txn_id", *forest.FEATURES))  # read for the profile, the draw and the scores
    known = profile(rows, forest.FEATURES, stored=True)
    scored = forest.with_raw_score(rows, forest.fit(rows, known=known))
    scored = ensemble.checkpointed(scored.select("txn_id", "actual_price", "margin_percent", "forest_raw"))
    return ensemble.with_top_shares(scored, [("forest_raw", "anomaly_score")], 0.07).where("anomaly_score is not null")


@on_fact()
def lof_transactions(fact):
    rows = ensemble.checkpointed(fact.select("txn_id", *lof.FEATURES))  # read for the scales, the locations and the join
    factors = lof.factors(rows)
    scored = ensemble.checkpointed(lof.join_factors(rows, factors).select("txn_id", *lof.FEATURES, "lof_raw"))
    discard(rows, factors)
    return ensemble.with_top_shares(scored, [("lof_raw", "anomaly_score")], 0.07).where("anomaly_score is not null")


def drug_points(fact: DataFrame) -> DataFrame:
    """Mean price, margin and volume per drug, rounded so that engines agree on the points."""
    return ensemble.checkpointed(fact.groupBy("drug_id").agg(  # the fit reads them several times
        *[rounded(F.avg(c), 4).alias(c) for c in lof.FEATURES]))


@on_fact(4)
def lof_drugs(fact):
    points = drug_points(fact)
    return lof.join_factors(points, lof.factors(points)).select("drug_id", F.col("lof_raw").alias("factor"))


@on_fact(4)
def lof_drugs_leaves(fact):
    points = drug_points(fact)
    return lof.join_factors(points, lof.factors(points, leaf_rows=64)).select("drug_id", F.col("lof_raw").alias("factor"))


@on_fact()
def robust_scale(fact):
    scaled = statistical.robust_scale(fact, lof.FEATURES)
    return fact.select("txn_id", *[c.alias(name) for name, c in scaled.items()])


@on_results()
def merge_flags(found):
    return found.select(
        "txn_id", "anomaly_type", "detection_method", "n_methods", "anomaly_score", "severity", "recommended_action")


@query()
def flags_long(spark, folder):
    return ensemble.flags_long(ensemble.with_flags(pricing_fact(spark, folder)), ["txn_id"])


@query()
def detect_sql(spark, folder):
    return ensemble.detect_all(pricing_fact(spark, folder), ensemble.SQL_METHODS).drop("description", "methods")


@query()
def detect_sql_stored(spark, folder):
    """The detectors fitted, stored, loaded and applied without fitting."""
    fact, state = pricing_fact(spark, folder), scratch_path(spark, "detectors")
    fitted.save(spark, fitted.fit(fact, ("zscore", "iqr")), state)
    return ensemble.detect_all(fact, ensemble.SQL_METHODS, fitted=fitted.load(spark, state)).drop("description", "methods")


@query()
def detect_all(spark, folder):
    return ensemble.detect_all(pricing_fact(spark, folder))


@on_annotated()
def annotate(annotated):
    return annotated.select(
        "txn_id", F.col("anomaly_type").isNotNull().alias("anomaly"),
        F.col("anomaly_type").alias("anomaly_reason"), F.coalesce("anomaly_score", F.lit(0.0)).alias("anomaly_score"))


@on_annotated(4)
def detect_summary(annotated):
    return ensemble.summary(annotated).select(
        "total_rows", "total_anomalies", "anomaly_rate_pct",
        F.transform(F.sort_array(F.map_entries("by_reason")),
                    lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))).alias("by_reason"))


# The same figures from stored summaries

def yearly(annotated: DataFrame) -> summaries.Summaries:
    """Summaries with a batch per year, stored and read again."""
    return summaries.add(annotated, scratch_path(annotated.sparkSession, "summaries"), F.year("transaction_date"))


@on_annotated(4)
def kpis_stored(annotated):
    return summaries.kpis(yearly(annotated))


@on_annotated()
def anomaly_timeline_stored(annotated):
    return summaries.timeline(yearly(annotated))


@on_annotated(4)
def wac_trend_stored(annotated):
    return summaries.wac_trend(yearly(annotated))


@on_annotated(4)
def gtn_quarter_stored(annotated):
    return summaries.gtn_by_quarter(yearly(annotated))


@on_annotated()
def margin_box_stored(annotated):
    """Approximate quartiles, from rank sketches."""
    return summaries.five_numbers(yearly(annotated), "margin_percent")


# Price history

@on_fact(4)
def price_history(fact):
    return history.price_history(fact)


@on_fact(4)
def extra_rules(fact):
    found = rules.annotate_price_history(history.price_history(fact))
    return found.select("ndc", "period", "anomaly", "anomaly_reason", "anomaly_score")


@on_fact()
def validate_price_history(fact):
    return rules.validate_price_history(history.price_history(fact))


@on_fact(4)
def ceiling_340b(fact):
    return fact.select(
        "txn_id", prices.ceiling_340b().alias("innovator"),
        prices.ceiling_340b(rebate=prices.REBATE_NON_INNOVATOR).alias("non_innovator"))


@on_fact(4)
def gtn_waterfall(fact):
    return history.gtn_waterfall(fact, {
        "chargebacks": F.col("wac_price") - F.col("amp_price"), "rebates": F.col("amp_price") - F.col("gtn_price")})


@on_fact(4)
def competitive_snapshot(fact):
    return history.competitive_snapshot(history.competitors(fact))


# Text

def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread_table(spark, folder, "documents").select(
        "doc_id", F.col("lang").alias("title"), F.col("source").alias("topic"), F.col("text").alias("content"))


@query()
def chunk_docs(spark, folder):
    return chunk_documents(documents(spark, folder)).select(
        "doc_id", "chunk_index", "chunk_id", "text", F.col("metadata")["topic"].alias("topic"))


@query()
def context_pack(spark, folder):
    ranked = chunk_documents(documents(spark, folder)).select(
        "doc_id", "chunk_index", "text", F.col("metadata")["topic"].alias("topic"),
        F.col("metadata")["title"].alias("title"))
    return context.context_pack(ranked, "doc_id", "chunk_index")


@query()
def tfidf_embed(spark, folder):
    """The vector of every chunk."""
    chunks = chunk_documents(documents(spark, folder)).select("doc_id", "chunk_index", "chunk_id", "text")
    return embed.tfidf_embed(chunks, embed.fit_tfidf(chunks)).drop("text")


@query()
def vector_topk(spark, folder):
    return closest_to_means(spark, folder)


@query()
def vector_topk_cells(spark, folder):
    return closest_to_means(spark, folder, max_broadcast=3, rows_per_cell=100)


@query()
def vector_topk_pruned(spark, folder):
    store, means = store_and_means(spark, folder)
    index = pruned.build_pruned(store, scratch_path(spark, "cells"), id_col="vec_id")
    return pruned.pruned_top_k(index, means).select("query_id", "id", "place", "similarity")


@query()
def vector_topk_hashed(spark, folder):
    """Approximate: what hash tables find of the same."""
    store, means = store_and_means(spark, folder)
    index = lsh.build_hashes(store, scratch_path(spark, "hashes"), id_col="vec_id")
    return lsh.approximate_top_k(index, means).select("query_id", "id", "place", "similarity")


def store_and_means(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The vectors, and the mean vector of each label as a query."""
    store = spread_table(spark, folder, "embeddings")
    means = store.groupBy("label").agg(Summarizer.mean(array_to_vector("embedding")).alias("m")).select(
        F.col("label").alias("query_id"), vector_to_array("m").alias("embedding"))
    return store, means


def closest_to_means(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The vectors closest to the mean vector of each label."""
    store, means = store_and_means(spark, folder)
    return search.top_k(store, means, 4, id_col="vec_id", **options).select("query_id", "id", "place", "similarity")


def retrieved(spark: SparkSession, folder: str) -> DataFrame:
    index, model = retrieval.build(documents(spark, folder), scratch_path(spark, "index"))
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.retrieve(index, model, asked).select(
        "query_id", "place", "similarity", F.col("id").alias("chunk_id"), "doc_id",
        F.col("metadata")["topic"].alias("topic"), F.col("metadata")["title"].alias("title"), "text", "snippet")


@query()
def retrieve(spark, folder):
    """The best passages for each text of the benchmark table."""
    return retrieved(spark, folder).drop("text")


@query()
def retrieved_context(spark, folder):
    """The retrieved passages of each question packed into its context."""
    return context.context_pack(retrieved(spark, folder))
