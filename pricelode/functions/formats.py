"""Display formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usd(value: Column, decimals: int = 2) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, decimals))


def pct(fraction: Column, decimals: int = 1) -> Column:
    return F.format_string(f"%.{decimals}f%%", fraction * 100)


def iso_date(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def anomaly_label(flag: Column) -> Column:
    return F.when(flag, "Anomaly").otherwise("Normal")


def severity_label(severity: Column) -> Column:
    return F.initcap(severity)
