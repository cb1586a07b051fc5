"""Price metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelode.functions.numbers import rounded

# Statutory rebate shares taken off AMP.
REBATE_INNOVATOR = 0.2302
REBATE_NON_INNOVATOR = 0.1302


def gtn_discount(wac: str = "wac_price", gtn: str = "gtn_price", scale: float = 1.0, clip: bool = False) -> Column:
    """Gross-to-net discount: a fraction (scale 1) or a percentage (scale 100), optionally kept within bounds."""
    share = F.try_divide(F.col(wac) - F.col(gtn), F.col(wac))
    if scale != 1.0:
        share = share * F.lit(scale)
    if not clip:
        return share
    bounded = F.least(F.greatest(share, F.lit(0.0)), F.lit(float(scale)))
    return F.when(share.isNotNull(), bounded)


def margin_percent(asp: str = "asp_price", actual: str = "actual_price") -> Column:
    return rounded(F.try_divide(F.col(asp) - F.col(actual), F.col(asp)) * 100, 4)


def ceiling_340b(amp: str | Column = "amp_price", rebate: float = REBATE_INNOVATOR) -> Column:
    return rounded((F.col(amp) if isinstance(amp, str) else amp) * (F.lit(1.0) - F.lit(rebate)), 4)


def month(ts: str = "transaction_date") -> Column:
    return F.date_format(ts, "yyyy-MM")


def quarter(ts: str = "transaction_date") -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))
