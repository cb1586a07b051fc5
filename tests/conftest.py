from __future__ import annotations

import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pricelode import schema


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def transactions(spark):
    """A transaction table from partial rows; what is not given is an unremarkable value."""
    def make(rows: list[dict]):
        full = []
        for i, row in enumerate(rows):
            base = dict(
                txn_id=f"t{i:05d}", drug_id="D1", drug_name="drug one", ndc_code="n", manufacturer="m",
                drug_class="C", pharmacy_id="P1", pharmacy_name="pharmacy one", pharmacy_chain="chain", state="CA",
                wac_price=100.0, asp_price=95.0, amp_price=85.0, price_340b=70.0, gtn_price=70.0,
                nadac_price=88.0, actual_price=90.0, margin_percent=5.0,
                transaction_date=dt.date(2024, 1, 1) + dt.timedelta(days=i), volume_units=30,
                is_anomaly=False, anomaly_type=None)
            base.update(row)
            full.append(tuple(base[f.name] for f in schema.TRANSACTIONS.fields))
        return spark.createDataFrame(full, schema.TRANSACTIONS)
    return make
