"""Sequences of a key give the same result on the plain and on the sliced route."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from pricelode.operators.timeseries import mom_flags, price_changes, rolling_zscore, volume_outliers
from pricelode.plans import ordered
from pricelode.plans.ordered import find_hot_keys
from registry.queries import QUERIES

HOT = {"one_in": 1, "min_sampled": 10}


@pytest.fixture(scope="module")
def sequences(transactions):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        hot = i % 3 == 0
        rows.append(dict(
            drug_id="HOT" if hot else f"D{i % 57}", pharmacy_id="P" if hot else f"P{i % 2}",
            actual_price=None if rng.random() < 0.1 else float(np.round(rng.uniform(50, 150), 2)),
            transaction_date=dt.date(2024, 1, 1) + dt.timedelta(days=int(rng.integers(0, 25)))))
    rows.append(dict(drug_id=None, actual_price=5.0))
    return transactions(rows).repartition(3)


def as_dict(df, *cols):
    return {r["txn_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_hot_keys_are_found_and_null_keys_are_not(sequences):
    found = find_hot_keys(sequences, ["drug_id", "pharmacy_id"], "txn_id", **HOT)
    assert [tuple(r) for r in found.collect()] == [("HOT", "P")]
    assert find_hot_keys(sequences, ["drug_id"], "txn_id") is None


def test_previous_price_is_the_same_on_both_routes(sequences):
    plain = as_dict(price_changes(sequences), "previous_price", "price_change")
    sliced = as_dict(price_changes(sequences, **HOT), "previous_price", "price_change")
    assert len(plain) == 401 and plain == sliced

    rows = sequences.toPandas().dropna(subset=["drug_id", "actual_price"])
    rows = rows.sort_values(["transaction_date", "txn_id"])
    expected = rows.groupby(["drug_id", "pharmacy_id"])["actual_price"].shift(1)
    for txn, value in zip(rows["txn_id"], expected):
        assert plain[txn][0] == (None if pd.isna(value) else value)


def test_rolling_statistics_are_the_same_on_both_routes(sequences):
    plain = as_dict(rolling_zscore(sequences, window=5), "rolling_mean", "rolling_std", "z")
    sliced = as_dict(rolling_zscore(sequences, window=5, **HOT), "rolling_mean", "rolling_std", "z")
    assert plain.keys() == sliced.keys()
    for txn, values in plain.items():
        for a, b in zip(values, sliced[txn]):
            assert a == b or a == pytest.approx(b, rel=1e-9)


def test_hot_route_evaluates_its_input_once(spark, sequences):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = mom_flags(sequences.mapInArrow(counted, sequences.schema), **HOT)
    sampled = seen.value  # looking for hot keys reads the input too
    assert rows.count() == 401 and seen.value - sampled in (0, 401) and sampled <= 2 * 401


def test_every_row_stays(sequences):
    assert mom_flags(sequences).count() == sequences.count()
    assert mom_flags(sequences, **HOT).count() == sequences.count()


def test_moves_at_the_thresholds(transactions):
    prices = [100.0, 125.0, 126.0, 200.0, 160.0, 120.0, 0.0, 5.0, 0.0, 0.0]
    rows = mom_flags(transactions([dict(actual_price=p) for p in prices])).orderBy("txn_id").collect()
    assert [r["mom_type"] for r in rows] == [
        None, None, None, "mom_spike", None, "mom_drop", "mom_drop", "mom_spike", "mom_drop", None]
    assert rows[3]["mom_score"] == pytest.approx((200 / 126 - 1) / 1.0)
    assert rows[5]["mom_score"] == pytest.approx(0.25 / 0.8)
    assert rows[7]["mom_score"] == 1.0  # from zero


def test_same_date_falls_back_to_the_id(transactions):
    day = dt.date(2024, 1, 1)
    df = transactions([dict(txn_id="b", actual_price=200.0, transaction_date=day),
                       dict(txn_id="a", actual_price=100.0, transaction_date=day)])
    assert as_dict(mom_flags(df), "mom_type") == {"a": (None,), "b": ("mom_spike",)}


def test_planted_spike(transactions):
    rows = [dict(actual_price=100.0 + i) for i in range(12)] + [dict(drug_id="D2", actual_price=50.0)]
    rows[11]["actual_price"] = 10_000.0
    found = rolling_zscore(transactions(rows)).where("is_spike").collect()
    assert [r["txn_id"] for r in found] == ["t00011"]


def test_volume_outlier(transactions):
    rows = [dict(volume_units=30 + i % 3) for i in range(40)] + [dict(volume_units=500), dict(drug_id="D2")]
    assert [r["volume_units"] for r in volume_outliers(transactions(rows)).collect()] == [500]


def test_slices_of_several_days_and_uncut_keys_give_the_same(sequences):
    plain = as_dict(rolling_zscore(sequences, window=5), "rolling_mean", "rolling_std")
    for rows in (1, 12, 40, 10_000):
        sliced = as_dict(rolling_zscore(sequences, window=5, slice_rows=rows, **HOT), "rolling_mean", "rolling_std")
        assert plain.keys() == sliced.keys()
        for txn, values in plain.items():
            assert all(a == b or a == pytest.approx(b, rel=1e-9) for a, b in zip(values, sliced[txn]))


def test_sparse_keys_carry_few_rows(transactions, monkeypatch):
    """With one row a day, a slice per day would copy for every row all those that its frame looks back on."""
    rows = transactions([dict(drug_id=f"D{i % 2}", transaction_date=dt.date(2024, 1, 1) + dt.timedelta(days=i)) for i in range(900)])
    windowed = []
    union = DataFrame.unionByName

    def counted(a, b, **options):
        if "_carried" in a.columns:
            windowed.append((a.count(), b.count()))
        return union(a, b, **options)

    monkeypatch.setattr(DataFrame, "unionByName", counted)
    got = as_dict(rolling_zscore(rows, one_in=1, min_sampled=20), "rolling_mean")
    assert got == as_dict(rolling_zscore(rows), "rolling_mean")
    (own, carried), = windowed
    assert own == 900 and 0 < carried <= 90


def test_hot_routes_write_only_the_columns_they_use(spark, monkeypatch):
    written, checkpointed = [], ordered.checkpointed
    monkeypatch.setattr(ordered, "checkpointed", lambda df, *by: written.append(set(df.columns)) or checkpointed(df, *by))
    for name in ("mom_hot", "zscore_rolling_hot"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0
    assert len(written) > 2 and not any({"drug_name", "wac_price"} & columns for columns in written)
