"""Stored summaries give the figures of the transactions they were added from."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelode.operators import dashboard, ensemble, summaries
from pricelode.plans import durable
from pricelode.sources.tpch import pricing_fact


@pytest.fixture(scope="module")
def annotated(spark, tmp_path_factory):
    fact = pricing_fact(spark, "/root/testdata/sf0.001")
    path = str(tmp_path_factory.mktemp("annotated") / "rows")
    ensemble.annotate(ensemble.with_flags(fact)).drop("methods").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def parts(annotated, tmp_path_factory):
    return summaries.add(annotated, str(tmp_path_factory.mktemp("summaries")), F.year("transaction_date"))


def rows(df):
    return sorted((tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def test_figures_are_those_of_the_transactions(annotated, parts):
    found = annotated.where("anomaly_type IS NOT NULL")
    assert rows(summaries.kpis(parts)) == rows(dashboard.kpis(annotated))
    for column in ("severity", "anomaly_type", "drug_class"):
        assert rows(summaries.counts_by(parts, column)) == rows(dashboard.counts_by(found, column))
    assert summaries.counts_by(parts, "drug_name", 10).collect() == dashboard.top_values(found, "drug_name", 10).collect()
    assert rows(summaries.timeline(parts)) == rows(dashboard.timeline(found))
    assert rows(summaries.wac_trend(parts)) == rows(dashboard.wac_trend(annotated))
    assert rows(summaries.gtn_by_month(parts)) == rows(dashboard.gtn_by_month(annotated))
    assert rows(summaries.benchmarks_long(parts)) == rows(dashboard.benchmarks_long(annotated))


def test_figures_do_not_scan_the_transactions(parts):
    for figure in (summaries.kpis(parts), summaries.timeline(parts), summaries.five_numbers(parts, "wac_price")):
        assert all("/summaries" in f for f in figure.inputFiles())


@pytest.mark.parametrize("value", summaries.SKETCHED)
def test_ranks_of_quartiles_are_close(annotated, parts, value):
    exact = {c: np.sort(g[value].to_numpy()) for c, g in annotated.select("drug_class", value).toPandas().groupby("drug_class")}
    found = summaries.five_numbers(parts, value).collect()
    assert {r["drug_class"] for r in found} == set(exact)
    for r in found:
        x = exact[r["drug_class"]]
        assert (r["low"], r["high"]) == (x[0], x[-1])
        for p, q in ((0.25, r["q1"]), (0.5, r["median"]), (0.75, r["q3"])):
            below, upto = np.searchsorted(x, q) / len(x), np.searchsorted(x, q, "right") / len(x)
            assert below - summaries.RANK_ERROR - 1 / len(x) <= p <= upto + summaries.RANK_ERROR + 1 / len(x)


def test_ranks_of_many_merged_sketches(spark):
    """The stated error also holds after merging hundreds of sketches of large days."""
    df = spark.range(400_000).select((F.col("id") % 400).alias("day"), F.pow(F.rand(1) * 10, 3).alias("x"))
    merged = df.groupBy("day").agg(F.kll_sketch_agg_double("x", summaries.SKETCH_K).alias("s")).agg(
        F.kll_merge_agg_double("s", summaries.SKETCH_K).alias("s"))
    got = merged.select(*(F.kll_sketch_get_quantile_double("s", F.lit(p)) for p in (0.01, 0.25, 0.5, 0.75, 0.99))).first()
    x = np.sort(np.array([r[0] for r in df.select("x").collect()]))
    for p, q in zip((0.01, 0.25, 0.5, 0.75, 0.99), got, strict=True):
        assert abs(np.searchsorted(x, q) / len(x) - p) <= summaries.RANK_ERROR


def test_a_batch_is_replaced_and_others_stay(spark, annotated, tmp_path):
    middle = annotated.agg(F.percentile_approx(F.year("transaction_date"), 0.5)).first()[0]
    first, second = (annotated.where(F.year("transaction_date") < middle), annotated.where(F.year("transaction_date") >= middle))
    folder = str(tmp_path / "parts")
    summaries.add(first, folder, "old")
    summaries.add(first.limit(10), folder, "new")
    parts = summaries.add(second, folder, "new")
    assert rows(summaries.kpis(parts)) == rows(dashboard.kpis(annotated))
    day = annotated.agg(F.to_date(F.max("transaction_date"))).first()[0].isoformat()
    last = summaries.five_numbers(parts, "wac_price", since=day, until=day)
    assert rows(last.select("drug_class", "low", "high")) == rows(
        annotated.where(F.to_date("transaction_date") == day).groupBy("drug_class").agg(F.min("wac_price"), F.max("wac_price")))


def test_missing_and_unknown(spark, parts, tmp_path):
    with pytest.raises(FileNotFoundError):
        summaries.load(spark, str(tmp_path / "absent"))
    with pytest.raises(ValueError):
        summaries.five_numbers(parts, "volume_units")


def test_nothing_to_add(annotated, tmp_path):
    parts = summaries.add(annotated.limit(0), str(tmp_path / "parts"), "none")
    assert rows(summaries.kpis(parts)) == rows(dashboard.kpis(annotated.limit(0))) and summaries.timeline(parts).collect() == []


def test_a_batch_of_many_rows_is_written_by_many_tasks(spark, annotated, tmp_path, monkeypatch):
    for setting in ("advisoryPartitionSizeInBytes", "coalescePartitions.minPartitionSize"):
        spark.conf.set(f"spark.sql.adaptive.{setting}", "4k")
    try:
        parts = summaries.add(annotated, str(tmp_path), "all")
    finally:
        for setting in ("advisoryPartitionSizeInBytes", "coalescePartitions.minPartitionSize"):
            spark.conf.unset(f"spark.sql.adaptive.{setting}")
    assert len(parts.drugs.inputFiles()) > 1
    assert rows(summaries.timeline(parts)) == rows(dashboard.timeline(annotated.where("anomaly_type IS NOT NULL")))


def test_rows_are_dealt_once_and_nothing_is_left_behind(spark, annotated, tmp_path):
    before = list(durable._STEPS)
    parts = summaries.add(annotated, str(tmp_path), F.year("transaction_date"))
    assert durable._STEPS == before and parts.drugs.count() > 0
    batch, day = F.year("transaction_date").cast("string"), F.to_date("transaction_date")
    stored = durable.checkpointed(annotated.select(batch.alias("batch"), day.alias("day"), *summaries._DRUGS[2:]))
    plan = summaries._by_drug(stored, [F.count("*").alias("n")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange rangepartitioning" in plan


def test_drugs_with_many_rows_on_a_day_are_summed_in_each_task(spark, annotated, parts, tmp_path, monkeypatch):
    wanted = rows(parts.drugs.select(sorted(parts.drugs.columns)))
    monkeypatch.setattr(summaries, "ONE_IN", 1)
    monkeypatch.setattr(summaries, "MANY_SAMPLED", 2)
    assert not annotated.groupBy("drug_id", F.to_date("transaction_date")).count().where("count > 1").isEmpty()
    nulls = annotated.withColumn("drug_id", F.when(F.col("drug_id") % 2 == 0, F.col("drug_id")))
    for n, df in enumerate((annotated, nulls)):
        crowded = summaries.add(df, str(tmp_path / f"crowded{n}"), F.year("transaction_date"))
        monkeypatch.setattr(summaries, "MANY_SAMPLED", 10 ** 9)
        plain = summaries.add(df, str(tmp_path / f"plain{n}"), F.year("transaction_date"))
        monkeypatch.setattr(summaries, "MANY_SAMPLED", 2)
        names = sorted(plain.drugs.columns)
        assert rows(crowded.drugs.select(names)) == rows(plain.drugs.select(names))
        assert n or rows(plain.drugs.select(names)) == wanted
