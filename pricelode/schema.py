"""Column contracts and the fixed values that results are compared on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = [
    "wac_price", "asp_price", "amp_price", "price_340b",
    "gtn_price", "nadac_price", "actual_price",
]

TRANSACTIONS = T.StructType(
    [T.StructField(c, T.StringType()) for c in (
        "txn_id", "drug_id", "drug_name", "ndc_code", "manufacturer", "drug_class",
        "pharmacy_id", "pharmacy_name", "pharmacy_chain", "state")]
    + [T.StructField(c, T.DoubleType()) for c in PRICES]
    + [
        T.StructField("margin_percent", T.DoubleType()),
        T.StructField("transaction_date", T.DateType()),
        T.StructField("volume_units", T.LongType()),
        T.StructField("is_anomaly", T.BooleanType()),
        T.StructField("anomaly_type", T.StringType()),
    ]
)

# What a transaction table must carry before any detector runs on it.
REQUIRED = [
    "txn_id", "drug_id", "drug_name", "pharmacy_id", "pharmacy_name",
    "wac_price", "asp_price", "amp_price", "price_340b",
    "gtn_price", "actual_price", "margin_percent", "volume_units",
]

# Columns of a price history and of the results.
PRICE_HISTORY_REQUIRED = ["ndc", "brand_name", "period", "wac_per_unit"]

RESULT_COLUMNS = [
    "drug_id", "drug_name", "pharmacy_id", "pharmacy_name", "pharmacy_chain", "state",
    "drug_class", "transaction_date", "wac_price", "actual_price", "margin_percent",
    "gtn_price", "anomaly_type", "detection_method", "severity", "anomaly_score",
    "description", "recommended_action",
]

# Fixed values.
REGULATORY_TYPES = [
    "wac_breach", "asp_wac_violation", "340b_ceiling_breach", "gtn_floor_breach", "margin_critical",
]
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2}


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing in the source data, but orders above every number in Spark."""
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[
        F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in doubles else F.col(c) for c in df.columns
    ])
