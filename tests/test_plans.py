"""Plans that must hold on large tables."""

from __future__ import annotations

import os
import pathlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from pricelode.operators import conversations, ensemble, reports, timeseries
from pricelode.plans import durable
from pricelode.sources.tpch import pricing_fact, table

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry_points.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {
    "detect_all", "lof_transactions", "lof_drugs", "iforest", "retrieve", "retrieved_context", "tfidf_embed"}))
def test_no_cross_joins_and_no_single_task_windows(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    single = [line for line in text.splitlines() if "Window [" in line and "], [" not in line]
    # The class summary asks once whether any class has an anomaly: a window over a row per class.
    assert len(single) == (name == "class_summary")


def test_scans_read_the_used_columns_only(spark):
    text = plan(timeseries.mom_flags(pricing_fact(spark, FOLDER)).select("txn_id", "mom_type"))
    assert "l_tax" not in text and "p_type" not in text


@pytest.mark.parametrize("make", [
    lambda spark: conversations.history_tail(table(spark, FOLDER, "conversations")),
    lambda spark: reports.top_anomalies(ensemble.annotate(ensemble.with_flags(pricing_fact(spark, FOLDER), ["rules"]))),
])
def test_top_rows_per_group_are_cut_before_the_shuffle(spark, make):
    text = plan(make(spark))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_merging_flags_needs_no_shuffle(spark):
    flagged = ensemble.with_flags(pricing_fact(spark, FOLDER), ["rules"])
    before = plan(flagged).count("Exchange hashpartitioning")
    assert plan(ensemble.annotate(flagged)).count("Exchange hashpartitioning") == before


def test_entity_reports_hash_the_rows(spark):
    text = plan(reports.pharmacy_risk(ensemble.annotate(ensemble.with_flags(pricing_fact(spark, FOLDER), ["rules"]))))
    first = [line for line in text.splitlines() if "Aggregate(" in line][-1]
    assert "HashAggregate" in first


def test_steps_are_removed_when_asked(spark, tmp_path):
    import os

    from pricelode.plans import durable
    step = durable.checkpointed(spark.range(10))
    folder = durable._STEPS[-1].removeprefix("file:")
    assert step.count() == 10 and os.path.isdir(folder)
    kept, durable._STEPS[:] = durable._STEPS[:-1], durable._STEPS[-1:]
    assert durable.remove_steps(spark) == 1 and not os.path.exists(folder) and durable._STEPS == []
    durable._STEPS[:] = kept


def shuffle_files(spark) -> set[str]:
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {str(f) for d in dirs for f in pathlib.Path(d.getPath()).rglob("shuffle_*")}


def test_steps_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    step = durable.checkpointed(spark.range(1_000).groupBy((F.col("id") % 7).alias("g")).count())
    assert step.count() == 7 and spark.conf.get(durable._FREE, "false") == "false"
    spark.range(1_000).repartition(3).count()  # queries that write no step are as they were
    assert not any(size for f in shuffle_files(spark) - before if (size := os.path.getsize(f)) > 5_000)


def test_a_discarded_step_is_gone_and_others_stay(spark):
    first, second = durable.checkpointed(spark.range(3)), durable.checkpointed(spark.range(5), ["id"][:0])
    paths = durable._STEPS[-2:]
    durable.discard(first)
    assert not os.path.exists(paths[0].removeprefix("file:")) and second.count() == 5 and durable._STEPS[-1] == paths[1]


@pytest.mark.parametrize("name", ["detect_all", "lof_transactions", "margin_box_stored", "wac_trend_stored"])
def test_only_what_the_result_reads_is_left(spark, name):
    before = set(durable._STEPS)
    files = QUERIES[name](spark, FOLDER).inputFiles()
    left = [s for s in durable._STEPS if s not in before]
    used = [s for s in left if any(s.removeprefix("file:") in f for f in files)]
    # Hot keys are sought in a table that is empty here.
    assert sum(f.stat().st_size for s in left if s not in used for f in pathlib.Path(s.removeprefix("file:")).rglob("*.parquet")) < 20_000
    assert len(used) <= 1
