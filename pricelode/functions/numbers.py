"""Rounding of published numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int) -> Column:
    """Rounded in decimals with halves away from zero: ten digits of the value count, not the last bits of a sum."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.round(c.try_cast("decimal(38,10)"), digits).cast("double"), F.round(c, digits))
