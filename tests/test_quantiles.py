from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricelode.operators.statistical import IqrFence, ZScore, robust_scale
from pricelode.plans import quantiles
from pricelode.plans.quantiles import exact_quantiles, grouped_quantiles, profile, quantile_table

PROBS = [0.0, 0.25, 0.5, 0.9, 1.0]


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [5.0] * 50, list(range(100)), [1e-9, 1.0, 1e9, 1e12, -1e12] * 7,
    list(np.random.default_rng(1).lognormal(3, 4, 3000)), list(np.random.default_rng(2).integers(0, 4, 2000)),
], ids=["one", "two", "equal", "range", "extremes", "tail", "repeats"])
def test_narrowing_equals_numpy(spark, values):
    df = frame(spark, values).repartition(3)
    got = exact_quantiles(df, ["x"], PROBS, bins=8, final_rows=5)["x"]
    np.testing.assert_allclose(got, np.quantile(values, PROBS), rtol=1e-12)
    # The same without narrowing.
    np.testing.assert_allclose(exact_quantiles(df, ["x"], PROBS)["x"], np.quantile(values, PROBS), rtol=1e-12)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_any_values(spark, values):
    got = exact_quantiles(frame(spark, values), ["x"], PROBS, bins=4, final_rows=3)["x"]
    np.testing.assert_allclose(got, np.quantile(values, PROBS), rtol=1e-9, atol=1e-9)


def test_nulls_are_skipped_and_empty_is_none(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    got = exact_quantiles(df, ["a", "b"], [0.5])
    assert got == {"a": [2.0], "b": [None]}
    assert profile(df, ["a"])["a"].nulls == 1


def test_groups_with_a_hot_one(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.normal(size=2000)] + [("cold", float(v)) for v in rng.normal(size=30)]
    rows += [(None, 1.0), ("empty", None)]
    got = grouped_quantiles(spark.createDataFrame(rows, "g string, x double"), "g", ["x"], PROBS, bins=16, final_rows=10)
    for g in ("hot", "cold"):
        np.testing.assert_allclose(got[g]["x"], np.quantile([v for k, v in rows if k == g], PROBS), rtol=1e-12)
    assert got[None]["x"] == [1.0] * 5
    assert got["empty"]["x"] == [None] * 5


def test_many_groups(spark):
    rows = spark.range(6000).selectExpr("id % 1500 AS g", "cast(id * 37 % 1009 AS double) AS x")
    got = {r["g"]: r["quantiles"] for r in quantile_table(rows, "g", ["x"], [0.25, 0.5]).collect()}
    assert len(got) == 1500
    for g in (0, 7, 1499):
        np.testing.assert_allclose(got[g], np.quantile([(g + 1500 * k) * 37 % 1009 for k in range(4)], [0.25, 0.5]))


@pytest.mark.parametrize("values", [
    [math.inf] + list(range(999)), [-math.inf, math.inf] * 10 + list(range(800)), [math.inf] * 600 + [1.0] * 300,
    [10.0**k for k in range(-290, 290)], [5.0] * 900, [5.0] * 700 + list(range(300)),
], ids=["one infinity", "both", "mostly infinite", "wide", "equal", "heavy"])
def test_passes_are_few_for_any_distribution(spark, values, monkeypatch):
    df = frame(spark, values).repartition(3).cache()
    passes = []
    narrow = quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda *a: passes.append(1) or narrow(*a))
    got = exact_quantiles(df, ["x"], PROBS, bins=8, final_rows=5)["x"]
    assert len(passes) <= 5
    ordered, n = sorted(map(float, values)), len(values)
    for p, v in zip(PROBS, got):
        a, b = ordered[math.floor(p * (n - 1))], ordered[min(math.floor(p * (n - 1)) + 1, n - 1)]
        assert v == a if a == b else v == pytest.approx(a + (b - a) * (p * (n - 1) % 1), rel=1e-9)
    table = quantile_table(df.withColumn("g", F.lit(1)), "g", ["x"], PROBS, bins=8, final_rows=5).first()["quantiles"]
    assert table == pytest.approx(got, rel=1e-9)


def test_an_infinite_value_flags_nothing_by_itself(spark):
    df = spark.createDataFrame([(float(i % 7),) for i in range(99)] + [(math.inf,)], "x double")
    fitted = ZScore.fit(df, ["x"])
    assert df.withColumns(fitted.columns()).where(fitted.flagged()).count() == 0
    fence = IqrFence.fit(df, ["x"])
    assert df.withColumns(fence.columns()).where(fence.flagged()).count() == 1


def test_robust_scale_fills_nulls_and_survives_a_zero_range(spark):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (None, 7.0), (4.0, 7.0), (9.0, 7.0)], "a double, b double")
    scaled = robust_scale(df, ["a", "b"])
    got = [tuple(r) for r in df.select(scaled["a"].alias("a"), scaled["b"].alias("b")).collect()]
    a = np.array([1.0, 2.0, 3.0, 4.0, 9.0])
    q1, q3 = np.quantile(a, [0.25, 0.75])
    np.testing.assert_allclose([g[0] for g in got], (a - 3.0) / (q3 - q1))
    assert all(g[1] == 0.0 for g in got)


def test_input_is_read_once_behind_its_profile(spark):
    values = list(np.random.default_rng(4).normal(size=3000))
    df, seen = frame(spark, values).repartition(3), spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = df.mapInArrow(counted, df.schema)
    known = profile(df, ["x"])
    seen.value = 0
    got = exact_quantiles(df, ["x"], PROBS, known, final_rows=5)["x"]
    np.testing.assert_allclose(got, np.quantile(values, PROBS), rtol=1e-12)
    assert seen.value == 3000
    seen.value = 0
    quantile_table(df.withColumn("g", F.lit(1)), "g", ["x"], PROBS, final_rows=5).collect()
    assert seen.value == 3000


def test_cuts_that_are_far_off_cost_a_pass_but_no_rank(spark):
    values = [float(v % 613) for v in range(2000)]
    df = frame(spark, values).repartition(3)
    known = profile(df, ["x"])
    known["x"].cuts = [600.0 + k / 100 for k in range(64)]
    np.testing.assert_allclose(exact_quantiles(df, ["x"], PROBS, known)["x"], np.quantile(values, PROBS), rtol=1e-12)
    known["x"].cuts = [k / 100 for k in range(64)]
    np.testing.assert_allclose(exact_quantiles(df, ["x"], PROBS, known, final_rows=5)["x"], np.quantile(values, PROBS), rtol=1e-12)
