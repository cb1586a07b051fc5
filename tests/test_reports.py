from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pricelode.functions import formats, prices
from pricelode.operators import causal, conversations, dashboard, ensemble, history, reports


def findings(spark, rows):
    """Annotated rows given as (pharmacy, drug, class, type, severity)."""
    full = [(f"t{i}", p, f"name {p}", "chain", "CA", d, f"drug {d}", c, t, s, 0.5, 100.0, 70.0)
            for i, (p, d, c, t, s) in enumerate(rows)]
    return spark.createDataFrame(
        full, "txn_id string, pharmacy_id string, pharmacy_name string, pharmacy_chain string, state string, "
              "drug_id string, drug_name string, drug_class string, anomaly_type string, severity string, "
              "anomaly_score double, wac_price double, gtn_price double")


def risk(spark, clean, *found):
    rows = [("P", "D", "C", None, None)] * clean + [("P", "D", "C", *f) for f in found]
    return reports.pharmacy_risk(findings(spark, rows)).collect()


def test_risk_tiers_are_closed_on_the_right(spark):
    # 2 points in 40 rows make 25.0, 2+2+2 in 50 make 60.0.
    assert [(r["risk_score"], r["risk_tier"]) for r in risk(spark, 39, ("iqr_outlier", "low"))] == [(25.0, "green")]
    three = [("iqr_outlier", "low")] * 3
    assert [(r["risk_score"], r["risk_tier"]) for r in risk(spark, 47, *three)] == [(60.0, "yellow")]
    assert [(r["risk_score"], r["risk_tier"]) for r in risk(spark, 46, *three)] == [(61.2, "red")]


def test_risk_is_capped_and_skips_clean_pharmacies(spark):
    assert risk(spark, 1, ("wac_breach", "high"))[0]["risk_score"] == 100.0
    assert risk(spark, 5) == []


def test_class_summary(spark):
    rows = [("P", "D", "A", "mom_drop", "low"), ("P", "D", "A", "wac_breach", "high"), ("P", "D", "A", None, None),
            ("P", "D", "A", None, None), ("P", "D", "B", None, None)]
    got = reports.class_summary(findings(spark, rows)).collect()
    assert [tuple(r) for r in got] == [("A", 0.5, 2.0, "mom_drop", pytest.approx(0.3))]
    clean = reports.class_summary(findings(spark, [r for r in rows if r[3] is None])).collect()
    assert [(r[0], r[1], r[2], r[3]) for r in clean] == [("A", 0.0, 0.0, None), ("B", 0.0, 0.0, None)]


@pytest.mark.parametrize("found,action", [
    ([("wac_breach", "high")], "regulatory_review"), ([("mom_spike", "high")], "escalate"),
    ([("mom_spike", "medium"), ("mom_drop", "low")], "investigate"), ([("mom_drop", "low")], "monitor"), ([], "monitor")])
def test_drug_report(spark, found, action):
    rows = [("P", "D", "C", t, s) for t, s in found] + [("P", "D", "C", None, None)]
    row = reports.drug_report(reports.only(findings(spark, rows), "drug_id", "D")).first()
    assert row["recommended_action"] == action and row["anomalies"] == len(found)
    assert row["top_violations"] == sorted(t for t, _ in found)
    assert sum(row["severity_breakdown"].values()) == len(found)


def test_drug_report_holds_the_trend(spark):
    day = lambda n: dt.date(2024, 6, 1) - dt.timedelta(days=n)
    rows = [("D", "a", "t1", day(0), 10.126), ("D", "b", "t2", day(0), 11.0), ("D", "a", "t0", day(0), 9.0), ("D", "a", "t3", day(90), 5.0),
            ("D", "a", "t4", day(91), 4.0), ("D", "a", "t5", day(30), None), ("E", "e", "t6", day(200), 7.0), ("F", "f", "t7", None, 1.0)]
    frame = spark.createDataFrame(
        [(d, n, t, when, price, None if t == "t3" else "wac_breach", "high") for d, n, t, when, price in rows],
        "drug_id string, drug_name string, txn_id string, transaction_date date, actual_price double, anomaly_type string, severity string")
    got = {r["drug_id"]: r["price_trend"] for r in reports.drug_report(frame).collect()}
    assert got["D"] == {day(0): 11.0, day(30): None, day(90): 5.0} and got["E"] == {day(200): 7.0} and not got["F"]


def test_unknown_drug(spark):
    with pytest.raises(LookupError):
        reports.only(findings(spark, [("P", "D", "C", None, None)]), "drug_id", "X")


def test_pharmacy_profile_counts_by_name(spark):
    rows = [("P", d, "C", t, s) for d, t, s in [
        ("a", "margin_critical", "high"), ("a", "wac_breach", "high"), ("b", "wac_breach", "high"),
        ("c", "asp_wac_violation", "high"), ("c", "margin_critical", "high"), ("d", "mom_drop", "low")]]
    row = reports.pharmacy_profile(findings(spark, rows)).first()
    assert row["regulatory_breach_count"] == 3  # a critical margin is no breach by name
    assert row["most_common_violation"] == "margin_critical"
    assert row["top_drugs"] == ["drug a", "drug c", "drug b"] and row["risk_tier"] == "yellow"


def test_price_trend_includes_the_ninetieth_day(transactions):
    day = dt.date(2024, 6, 1)
    rows = [dict(transaction_date=day - dt.timedelta(days=n), actual_price=float(n)) for n in (0, 89, 90, 91)]
    rows.append(dict(txn_id="z", transaction_date=day, actual_price=7.777))
    got = {r["day"]: r["actual_price"] for r in reports.price_trend(transactions(rows)).collect()}
    assert got == {day: 7.78, day - dt.timedelta(days=89): 89.0, day - dt.timedelta(days=90): 90.0}


def test_causal_summary(transactions):
    day = dt.date(2024, 1, 1)
    rows = [dict(actual_price=p, margin_percent=m, transaction_date=day + dt.timedelta(days=d))
            for p, m, d in [(10, -5, 0), (20, -5, 1), (30, 10, 1), (40, 10, 1), (50, 10, 3)]]
    rows = [{**r, "actual_price": float(r["actual_price"]), "margin_percent": float(r["margin_percent"])} for r in rows]
    rows.append(dict(drug_id="single"))
    got = {r["drug_id"]: r for r in causal.causal_summary(transactions(rows)).collect()}
    row = got["D1"]
    assert (row["pre_actual_price"], row["post_actual_price"]) == (15.0, 40.0)  # the middle falls inside a day
    assert row["price_change_pct"] == pytest.approx(166.6667, abs=1e-3) and row["trend"] == "increasing"
    assert row["margin_change_pct"] == pytest.approx(300.0)
    assert got["single"]["pre_actual_price"] is None and got["single"]["trend"] is None


def test_price_functions(spark):
    df = spark.createDataFrame([(100.0, 40.0), (100.0, 120.0), (0.0, 5.0), (None, 5.0)], "wac_price double, gtn_price double")
    g = prices.gtn_discount
    rows = df.select(g(clip=True), g(), g(scale=100.0), g(scale=100.0, clip=True)).collect()
    assert tuple(rows[0]) == (0.6, 0.6, 60.0, 60.0)
    assert rows[1][0] == 0.0 and rows[1][1] == pytest.approx(-0.2) and rows[1][3] == 0.0
    assert tuple(rows[2]) == tuple(rows[3]) == (None,) * 4
    one = spark.range(1).select(
        prices.ceiling_340b(F.lit(100.0)), prices.ceiling_340b(F.lit(100.0), prices.REBATE_NON_INNOVATOR),
        formats.usd(F.lit(1234.5)), formats.usd(F.lit(0.0)), formats.pct(F.lit(0.1523)),
        formats.severity_label(F.lit("high"))).first()
    assert tuple(one) == (76.98, 86.98, "$1,234.50", "$0.00", "15.2%", "High")


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 10)], "x double")
    got = {r["bin"]: r["n"] for r in dashboard.histogram(df, F.col("x"), 5).collect()}
    assert got == {0: 2, 1: 2, 2: 0, 3: 0, 4: 1}
    same = dashboard.histogram(df.where("x = 1"), F.col("x"), 5).collect()
    assert sorted((r["bin"], r["n"]) for r in same) == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 0)]


def test_explore_filters(spark):
    df = findings(spark, [("P", "a", "C", "wac_breach", "high"), ("P", "b", "C", "mom_drop", "low")])
    assert dashboard.explore(df).count() == 2
    assert dashboard.explore(df, ["low"]).first()["drug_id"] == "b"
    assert dashboard.explore(df, types=["wac_breach"], drug_name="drug b").count() == 0
    assert [r[0] for r in dashboard.filter_options(df, "anomaly_type").collect()] == ["mom_drop", "wac_breach"]


def test_method_coverage_counts_whole_labels(transactions):
    df = transactions([dict(actual_price=90.0 + i % 5) for i in range(60)] + [dict(actual_price=240.0, drug_id="D9")])
    found = ensemble.results(ensemble.annotate(ensemble.with_flags(df)))
    assert {r["method"] for r in dashboard.method_coverage(found).collect()} == {"Z-Score", "IQR Fence"}


def test_history_and_snapshot(transactions):
    df = transactions([dict(), dict(drug_id="D2", drug_name="drug two", manufacturer="n")])
    monthly = history.price_history(df)
    assert history.history_of(monthly, "drug two").count() == 1
    with pytest.raises(LookupError):
        history.history_of(monthly, "NONEXISTENT_DRUG_XYZ")
    shares = history.competitive_snapshot(history.competitors(df), "C").collect()
    assert [r["market_share_pct"] for r in shares] == [50.0, 50.0]
    steps = {r["step"]: r["amount"] for r in history.gtn_waterfall(
        df, {"chargebacks": F.lit(10.0), "rebates": F.lit(20.0)}).where("drug_id = 'D1'").collect()}
    assert steps == {"wac": 100.0, "chargebacks": 10.0, "rebates": 20.0, "net": 70.0}


def test_conversations(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}" * 60) for t in range(9)] + [(2, 0, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in conversations.conversation_summary(df).collect()}
    assert got[1]["total_turns"] == 5 and got[1]["last_user_message"].startswith("m8")
    assert got[1]["last_assistant_preview"] == ("m7" * 60)[:100]
    assert (got[2]["last_user_message"], got[2]["last_assistant_preview"]) == ("", "")
    assert conversations.history_tail(df, 6).where("conv_id = 1").agg(F.min("turn")).first()[0] == 3
    assert conversations.history_tail(df, 20).count() == 10
