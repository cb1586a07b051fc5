from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pricelode.plans.durable import shared_dir
from pricelode.sources import adhoc, tables
from pricelode.sources.tpch import pricing_fact
from pricelode.operators.dashboard import pivoted, gtn_by_month

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_round_trip(spark, transactions, tmp_path, fmt):
    df = transactions([dict(actual_price=1.25), dict(actual_price=None)])
    path = tables.save(df, str(tmp_path / "prices"), fmt)
    back = tables.scan_pricing(spark, path)
    assert sorted(back.collect(), key=lambda r: r["txn_id"]) == df.collect()


def test_rows_without_an_id_get_one(spark, transactions, tmp_path):
    df = transactions([dict(txn_id="x")] * 3 + [dict(actual_price=1.0)]).withColumn(
        "transaction_date", F.lit("2024-01-01").cast("date")).drop("txn_id")
    back = tables.scan_pricing(spark, tables.save(df, str(tmp_path / "bare"), "csv"))
    ids = [r["txn_id"] for r in back.collect()]
    assert len(set(ids)) == 4 and len({i.split("-")[0] for i in ids}) == 2
    assert sorted(ids) == sorted(r["txn_id"] for r in back.repartition(3).collect())


def test_row_ids_come_from_the_scan(spark, transactions, tmp_path):
    df = transactions([dict(actual_price=1.0)] * 6).drop("txn_id").repartition(3)
    path = tables.save(df, str(tmp_path / "bare"))
    back = tables.scan_pricing(spark, path)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    ids = sorted(r["txn_id"] for r in back.collect())
    assert len(set(ids)) == 6 and ids == sorted(r["txn_id"] for r in tables.scan_pricing(spark, path).repartition(2).collect())
    assert back.where("actual_price > 2").count() == 0 and back.columns[0] == "txn_id"


def test_unknown_formats(spark, transactions, tmp_path):
    with pytest.raises(ValueError):
        tables.load(spark, "x.xlsx")
    with pytest.raises(ValueError):
        tables.save(transactions([{}]), str(tmp_path / "x"), "xlsx")


def test_contract(spark, transactions, tmp_path):
    path = tables.save(transactions([{}]).drop("wac_price"), str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="wac_price"):
        tables.scan_pricing(spark, path)


def test_nan_is_missing(transactions):
    row = tables.prepared(transactions([dict(actual_price=float("nan"))])).first()
    assert row["actual_price"] is None and row["margin_percent"] == 5.0


def test_results_are_laid_out_by_severity(spark, transactions, tmp_path):
    from pricelode.operators import ensemble
    found = ensemble.detect_all(transactions([dict(actual_price=300.0), {}]), ["rules"])
    path = tables.save_results(found, str(tmp_path / "results"))
    high = spark.read.parquet(path).where("severity = 'high'")
    assert high.count() == 1 and "PartitionFilters: [isnotnull(severity" in high._jdf.queryExecution().toString()


def test_star_schema_and_adhoc_queries(spark, transactions, tmp_path):
    df = transactions([dict(is_anomaly=True, anomaly_type="price_spike"), dict(drug_id="D2"), dict(pharmacy_id="P2")])
    paths = tables.save_star(tables.star_schema(df), str(tmp_path))
    assert set(paths) == {"drugs", "pharmacies", "transactions", "anomalies"}
    star = tables.load_star(spark, str(tmp_path))
    assert {k: v.count() for k, v in star.items()} == {"drugs": 2, "pharmacies": 2, "transactions": 3, "anomalies": 1}
    assert tables.star_join(star).count() == 3
    spark.range(7).createOrReplaceTempView("drugs")
    assert adhoc.query(spark, "SELECT count(*) AS n FROM transactions;", star).first()["n"] == 3
    assert adhoc.query(spark, "with t as (select * from drugs) select * from t", star).count() == 2
    assert adhoc.query(spark, "SELECT a.tx_id FROM transactions a JOIN transactions b JOIN drugs", star, 5).count() == 5
    assert adhoc.query(spark, "SELECT a.tx_id FROM transactions a JOIN transactions b JOIN transactions c", star).count() == 27
    assert adhoc.query(spark, "SELECT * FROM drugs WHERE drug_id = 'none'", star).isEmpty()
    assert spark.table("drugs").count() == 7 and not spark.catalog.tableExists("pharmacies")
    spark.catalog.dropTempView("drugs")


@pytest.mark.parametrize("sql", ["", "DROP TABLE drugs", "insert into drugs values (1)", "PRAGMA x"])
def test_statements_that_are_no_query_are_refused(spark, sql):
    with pytest.raises(ValueError):
        adhoc.query(spark, sql, {})


def test_a_write_behind_a_with_does_not_parse(spark):
    with pytest.raises(Exception):
        adhoc.query(spark, "WITH t AS (SELECT 1) INSERT INTO drugs SELECT * FROM t", {})


class FakeSession:
    """Just enough of a session to ask where its cluster keeps checkpoints."""

    def __init__(self, master, configured=None):
        self.conf, self.sparkContext, self.master, self.configured = self, self, master, configured

    def get(self, name, default):
        return self.configured if name == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return None


def test_shared_folder_follows_the_session():
    assert shared_dir(FakeSession("yarn", "hdfs:///shared")) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        shared_dir(FakeSession("yarn"))  # never a folder of one machine


def test_pivot(spark):
    wide = pivoted(gtn_by_month(pricing_fact(spark, FOLDER)), "month", fill=0.0)
    assert wide.count() == 6 and len(wide.columns) > 12
