from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pricelode import schema
from pricelode.operators import ensemble, rules
from pricelode.operators.statistical import IqrFence, ZScore


def annotated(df, methods=ensemble.SQL_METHODS, **options):
    return ensemble.annotate(ensemble.with_flags(df, methods, **options))


def by_id(df):
    return {r["txn_id"]: r for r in df.collect()}


def test_constant_columns_flag_nothing(transactions):
    df = transactions([{} for _ in range(30)])
    assert ensemble.results(annotated(df)).count() == 0
    assert ZScore.fit(df).z("actual_price")._jc.toString() == "0.0"


def test_zero_iqr_flags_any_other_value(transactions):
    df = transactions([{} for _ in range(30)] + [dict(actual_price=90.5)])
    fence = IqrFence.fit(df)
    rows = df.withColumns(fence.columns()).where(fence.flagged()).collect()
    assert [r["txn_id"] for r in rows] == ["t00030"] and rows[0]["iqr_feature"] == "actual_price"


def test_zscore_comes_before_iqr(transactions):
    df = transactions([dict(actual_price=90.0 + i % 5) for i in range(60)] + [dict(actual_price=240.0, drug_id="D9")])
    row = by_id(annotated(df))["t00060"]
    assert row["anomaly_type"] == "zscore_outlier"
    assert row["detection_method"] == "Z-Score | IQR Fence"
    assert (row["severity"], row["recommended_action"]) == ("medium", "investigate")


def test_several_rules_are_one_method_and_high(transactions):
    df = transactions([dict(actual_price=300.0, asp_price=110.0, price_340b=80.0, gtn_price=40.0, margin_percent=-50.0)])
    row = by_id(annotated(df, ["rules"]))["t00000"]
    assert row["anomaly_type"] == "wac_breach" and row["n_methods"] == 1
    assert (row["severity"], row["recommended_action"], row["anomaly_score"]) == ("high", "regulatory_review", 1.0)
    assert rules.violations(df, ["txn_id"]).count() == 5


def test_rule_limits_are_exclusive_and_missing_values_do_not_fire(transactions):
    df = transactions([
        dict(margin_percent=-20.0), dict(actual_price=250.0), dict(margin_percent=None, actual_price=None),
        dict(margin_percent=-20.1)])
    assert [r["txn_id"] for r in rules.violations(df, ["txn_id"]).collect()] == ["t00003"]


def test_three_methods_are_high_and_escalate(transactions):
    df = transactions([dict(actual_price=90.0 + i % 5) for i in range(60)] + [dict(actual_price=240.0)])
    row = by_id(annotated(df))["t00060"]
    assert row["anomaly_type"] == "mom_spike" and row["n_methods"] == 3
    assert (row["severity"], row["recommended_action"]) == ("high", "escalate")
    assert "rose" in row["description"]


def test_missing_numbers_read_as_the_median(transactions):
    df = transactions([dict(actual_price=float(v), margin_percent=float(v)) for v in range(1, 10)]
                      + [dict(actual_price=None, margin_percent=None, drug_id="D2")])
    z = ZScore.fit(df)
    row = df.withColumns(z.columns()).where("txn_id = 't00009'").first()
    assert z.medians == {"actual_price": 5.0, "margin_percent": 5.0}
    assert row["z_max"] == 0.0
    assert by_id(annotated(df))["t00009"]["anomaly_type"] is None


def test_empty_input(transactions):
    df = transactions([]) if False else transactions([{}]).limit(0)
    assert annotated(df).count() == 0
    assert annotated(df, ensemble.ALL_METHODS).count() == 0


def test_unknown_detector(transactions):
    with pytest.raises(ValueError):
        ensemble.with_flags(transactions([{}]), ["nope"])


def test_output_columns_order_and_annotate_mode(transactions):
    df = transactions([dict(actual_price=300.0), {}, dict(actual_price=150.0, pharmacy_id="P2")])
    found = ensemble.detect_all(df, ensemble.SQL_METHODS)
    assert found.columns == ["txn_id", *schema.RESULT_COLUMNS, "methods"]
    assert annotated(df).count() == 3
    assert {r["label_type"] for r in annotated(df).collect()} == {None}


def test_results_are_most_severe_first(transactions):
    rows = [dict(actual_price=100.0 + i % 7, drug_id=f"D{i}") for i in range(50)]
    rows += [dict(actual_price=300.0), dict(actual_price=180.0, drug_id="D0", pharmacy_id="P1")]
    found = ensemble.detect_all(transactions(rows), ensemble.SQL_METHODS).collect()
    ranks = [schema.SEVERITY_RANK[r["severity"]] for r in found]
    assert ranks == sorted(ranks) and found[0]["severity"] == "high"


def test_same_answer_for_any_partitioning(spark, transactions):
    rows = [dict(actual_price=50.0 + (i * 37) % 90, drug_id=f"D{i % 4}", margin_percent=float(i % 11) - 5)
            for i in range(200)]
    df = transactions(rows)
    wanted = ["txn_id", "anomaly_type", "severity", "anomaly_score"]
    answers = [
        sorted((r[0], r[1], r[2], round(r[3], 9)) for r in ensemble.results(annotated(d)).select(*wanted).collect())
        for d in (df.repartition(1), df.repartition(7))]
    assert answers[0] == answers[1] and answers[0]


def test_long_flags_and_summary(transactions):
    df = transactions([dict(actual_price=300.0, margin_percent=-50.0), {}, {}, {}])
    flagged = ensemble.with_flags(df, ["rules"])
    long = ensemble.flags_long(flagged, ["txn_id"]).collect()
    assert sorted(r["anomaly_type"] for r in long) == ["margin_critical", "wac_breach"]
    summary = ensemble.summary(ensemble.annotate(flagged)).first()
    assert (summary["total_rows"], summary["total_anomalies"], summary["anomaly_rate_pct"]) == (4, 1, 25.0)
    assert summary["by_reason"] == {"wac_breach": 1}


def test_rules_on_a_stream(spark, transactions, tmp_path):
    df = transactions([dict(actual_price=300.0), {}])
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    job = rules.violations(stream, ["txn_id"]).writeStream.format("memory").queryName("violations").start()
    try:
        job.processAllAvailable()
        assert [r["anomaly_type"] for r in spark.table("violations").collect()] == ["wac_breach"]
    finally:
        job.stop()


def test_price_history_rules_and_contract(spark):
    cols = "ndc string, brand_name string, period string, wac_per_unit double, gross_to_net_pct double, " \
           "best_price double, amp double, ceiling_340b double"
    good = ("1", "x", "2024-01", 10.0, 0.4, 8.0, 9.0, 5.0)
    df = spark.createDataFrame([good, ("2", "x", "2024-01", -1.0, 1.5, 13.5, 9.0, -10.0)], cols)
    bad = lambda frame: {(r[0], r[1]): r[2] for r in rules.validate_price_history(frame).collect() if r[2]}
    assert bad(df.where("ndc = '1'")) == {}
    assert bad(df) == {("negative", "wac_per_unit"): 1, ("outside_0_1", "gross_to_net_pct"): 1}
    assert bad(df.drop("period"))["missing", "period"] == 2
    rows = rules.annotate_price_history(df).orderBy("ndc").collect()
    assert [r["anomaly"] for r in rows] == [False, True] and rows[1]["anomaly_reason"] == "bp_exceeds_amp"
    only = rules.annotate_price_history(df.withColumn("best_price", F.lit(1.0))).where("anomaly").collect()
    assert [r["anomaly_reason"] for r in only] == ["negative_340b_ceiling"]


def test_fits_read_the_input_once(spark, transactions):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = transactions([{"actual_price": 50.0 + i % 7 + 900 * (i == 40), "drug_id": f"D{i % 3}"} for i in range(60)])
    plain = ensemble.annotate(ensemble.with_flags(rows)).orderBy("txn_id").collect()
    flagged = ensemble.with_flags(rows.mapInArrow(counted, rows.schema))
    assert seen.value == 60  # for the statistics, their quantiles and the hot keys together
    annotated = ensemble.annotate(flagged).orderBy("txn_id").collect()
    assert annotated == plain
    for r in annotated:
        assert (r["n_methods"], r["detection_method"]) == (len(r["methods"]), " | ".join(r["methods"]))
    assert {r["n_methods"] > 0 for r in annotated} == {True, False}


def test_hot_keys_from_keys_at_hand(spark, transactions):
    from pricelode.plans.ordered import find_hot_keys, is_sampled

    rows = transactions([{"drug_id": "hot" if i % 2 else f"D{i}"} for i in range(400)])
    keys = rows.select(F.when(is_sampled("txn_id", 4), F.col("drug_id")).alias("drug_id"))
    found = [find_hot_keys(rows, ["drug_id"], "txn_id", 4, 20, counted=True, **at) for at in ({}, {"sampled": keys})]
    assert found[0].collect() == found[1].collect() and found[0].first()["drug_id"] == "hot"


def test_profile_of_a_written_table_is_the_same(spark):
    from pricelode.plans.quantiles import profile

    df = spark.range(5000).selectExpr("cast(id * 37 % 1009 AS double) AS x", "if(id % 9 = 0, null, id / 3) AS y")
    assert profile(df, ["x", "y"], stored=True) == profile(df, ["x", "y"])
