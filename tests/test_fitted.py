"""Stored detectors give the rows of detectors that are fitted on the spot, and need no look at the table."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelode.operators import ensemble, fitted, forest
from pricelode.operators.statistical import filled
from pricelode.sources.tpch import pricing_fact

COLUMNS = ("txn_id", "z_max", "z_feature", "zscore_score", "iqr_distance", "iqr_feature", "iqr_score", "forest_raw", "forest_score")


@pytest.fixture(scope="module")
def fact(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fact") / "rows")
    rows = pricing_fact(spark, "/root/testdata/sf0.001")
    gap = F.when(F.xxhash64("txn_id") % 40 != 0, F.col("margin_percent"))
    rows.withColumn("margin_percent", gap).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def stored(spark, fact, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("detectors"))
    assert fitted.save(spark, fitted.fit(fact, trees=20), folder) == 1
    return folder


def rows(df):
    return sorted(df.select(*COLUMNS).collect(), key=lambda r: r["txn_id"])


def test_stored_detectors_give_the_same_rows(spark, fact, stored):
    methods = ("zscore", "iqr", "forest")
    want = rows(ensemble.with_flags(fact, methods, trees=20))
    assert rows(ensemble.with_flags(fact, methods, fitted=fitted.load(spark, stored))) == want
    assert sum(r["forest_score"] is not None for r in want) == pytest.approx(0.07 * 6000, abs=2)


def test_applying_runs_no_job(spark, fact, stored):
    known = fitted.load(spark, stored)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("apply", "apply")
    flagged = ensemble.with_flags(fact, ("zscore", "iqr", "forest", "rules"), fitted=known)
    assert len(tracker.getJobIdsForGroup("apply")) == 0
    assert "Exchange" not in flagged._jdf.queryExecution().executedPlan().toString()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_new_rows_are_judged_by_what_was_fitted(spark, fact, stored):
    known = fitted.load(spark, stored)
    one = fact.orderBy("txn_id").limit(1).withColumn("actual_price", F.lit(1e7))
    found = ensemble.with_flags(one, ("zscore", "iqr", "forest"), fitted=known).first()
    assert found["z_max"] > 100 and found["iqr_score"] == 1.0 and 0 < found["forest_score"] <= 1


def test_versions(spark, fact, stored):
    assert fitted.save(spark, fitted.fit(fact.limit(500), ("iqr",)), stored) == 2
    assert fitted.save(spark, fitted.Fitted(), stored) == 3
    assert fitted.versions(spark, stored) == [1, 2, 3]
    first, second = fitted.load(spark, stored, 1), fitted.load(spark, stored, 2)
    assert first.zscore and first.forest and second.zscore is None and second.iqr.fences != first.iqr.fences
    assert fitted.load(spark, stored) == fitted.Fitted()
    for folder, version in ((stored, 9), (f"{stored}/absent", None)):
        with pytest.raises(FileNotFoundError):
            fitted.load(spark, folder, version)
    with pytest.raises(ValueError):
        fitted.fit(fact, ("lof",))


def test_forest_scores_against_walking_each_tree(spark, fact, stored):
    """Path lengths of every transaction in every stored tree, one node at a time."""
    model = fitted.load(spark, stored, 1).forest
    got = forest.with_raw_score(fact, model).select(*(filled(c, model.medians).alias(c) for c in model.features), "forest_raw").toPandas()
    x, inner = got[model.features].to_numpy(float), model.feature.shape[1]
    for row, score in list(zip(x, got["forest_raw"], strict=True))[::97]:
        paths = []
        for feature, split, path in zip(model.feature, model.split, model.path, strict=True):
            node = 0
            while node < inner:
                node = 2 * node + (2 if row[feature[node]] > split[node] else 1)
            paths.append(path[node - inner])
        assert score == pytest.approx(2 ** (-np.mean(paths) / forest.mean_path(256)), rel=1e-12)
