"""Detectors that compare a row with statistics of the whole table.

The statistics are fitted first (a few numbers reach the driver) and enter the row-wise
expressions as literals, so applying a detector is a plain projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.plans.quantiles import ColumnProfile, exact_quantiles, profile

ZSCORE_FEATURES = ["actual_price", "margin_percent", "gtn_price"]
IQR_FEATURES = ["actual_price", "wac_price", "margin_percent"]
FLAT = 1e-9


def column_medians(
    df: DataFrame, cols: list[str], known: dict[str, ColumnProfile] | None = None,
) -> dict[str, float]:
    """Medians of the columns that have nulls to fill; the others need none."""
    known = known or profile(df, cols)
    gaps = [c for c in cols if known[c].nulls and known[c].n]
    return {c: q[0] for c, q in exact_quantiles(df, gaps, [0.5], known).items()} if gaps else {}


def filled(col: str, medians: dict[str, float]) -> Column:
    return F.coalesce(F.col(col), F.lit(medians[col])) if col in medians else F.col(col)


@dataclass
class ZScore:
    """|z| above ``threshold`` on any feature, measured over the whole table."""

    moments: dict[str, tuple[float, float]]
    medians: dict[str, float]
    threshold: float = 3.0

    @classmethod
    def fit(
        cls, df: DataFrame, features: list[str] = ZSCORE_FEATURES, threshold: float = 3.0,
        known: dict[str, ColumnProfile] | None = None,
    ) -> ZScore:
        known = known or profile(df, features)
        medians = column_medians(df, features, known)
        if medians:
            known = profile(df.select(*[filled(f, medians).alias(f) for f in features]), features)
        moments = {f: (known[f].mean, known[f].std) for f in features if known[f].std is not None}
        return cls(moments, medians, threshold)

    def z(self, feature: str) -> Column:
        mean, std = self.moments.get(feature, (0.0, 0.0))
        if not (std >= FLAT and math.isfinite(mean) and math.isfinite(std)):  # an infinite value leaves no measure
            return F.lit(0.0)
        return (filled(feature, self.medians) - F.lit(mean)) / F.lit(std)

    def columns(self) -> dict[str, Column]:
        """Largest |z| of the row, the first feature that reaches it, its signed z and value."""
        zs = {f: self.z(f) for f in self.moments}
        if not zs:
            return {"z_max": F.lit(0.0), "z_feature": F.lit(None).cast("string"),
                    "z_value": F.lit(None).cast("double")}
        top = F.greatest(F.lit(0.0), *[F.abs(z) for z in zs.values()])
        feature = F.coalesce(*[F.when(F.abs(z) == top, F.lit(f)) for f, z in zs.items()])
        value = F.coalesce(*[F.when(F.abs(z) == top, F.col(f)) for f, z in zs.items()])
        return {"z_max": top, "z_feature": feature, "z_value": value}

    def flagged(self) -> Column:
        return (F.col("z_max") > F.lit(self.threshold)) & ~F.isnan("z_max")

    def score(self) -> Column:
        return F.least(F.col("z_max") / F.lit(self.threshold * 3), F.lit(1.0))


@dataclass
class IqrFence:
    """Values beyond Q1 - k*IQR or Q3 + k*IQR; the distance is taken to the farther fence."""

    fences: dict[str, tuple[float, float, float]]
    multiplier: float = 2.5

    @classmethod
    def fit(
        cls, df: DataFrame, features: list[str] = IQR_FEATURES, multiplier: float = 2.5,
        known: dict[str, ColumnProfile] | None = None,
    ) -> IqrFence:
        fences = {}
        for f, (q1, q3) in filled_quantiles(df, features, [0.25, 0.75], known)[1].items():
            if q1 is not None:
                iqr = q3 - q1
                fences[f] = (q1 - multiplier * iqr, q3 + multiplier * iqr, iqr)
        return cls(fences, multiplier)

    def distance(self, feature: str) -> Column:
        """Distance in IQRs where the fence is breached, else null."""
        low, high, iqr = self.fences[feature]
        v = F.col(feature)
        far = F.greatest(F.abs(v - F.lit(low)), F.abs(v - F.lit(high))) / F.lit(iqr + 1e-9)
        return F.when((v < F.lit(low)) | (v > F.lit(high)), far)

    def columns(self) -> dict[str, Column]:
        none = F.lit(None)
        gaps = {f: self.distance(f) for f in self.fences}
        if not gaps:
            return {"iqr_distance": none.cast("double"), "iqr_feature": none.cast("string"),
                    "iqr_value": none.cast("double")}
        # greatest() skips nulls but wants two arguments.
        top = F.greatest(none.cast("double"), *gaps.values())
        return {
            "iqr_distance": top,
            "iqr_feature": F.coalesce(*[F.when(d == top, F.lit(f)) for f, d in gaps.items()]),
            "iqr_value": F.coalesce(*[F.when(d == top, F.col(f)) for f, d in gaps.items()]),
        }

    def flagged(self) -> Column:
        return F.col("iqr_distance").isNotNull()

    def score(self) -> Column:
        return F.least(F.col("iqr_distance") / 10, F.lit(1.0))


def filled_quantiles(
    df: DataFrame, cols: list[str], probs: list[float], known: dict[str, ColumnProfile] | None = None,
) -> tuple[dict[str, float], dict[str, list[float | None]]]:
    """The medians used to fill nulls, and the quantiles after filling."""
    known = known or profile(df, cols)
    medians = column_medians(df, cols, known)
    if medians:
        df, known = df.select(*[filled(c, medians).alias(c) for c in cols]), None
    return medians, exact_quantiles(df, cols, probs, known)


def robust_scale(df: DataFrame, cols: list[str]) -> dict[str, Column]:
    """(x - median) / (Q3 - Q1) per column, nulls read as the median, a zero range as 1."""
    medians, quartiles = filled_quantiles(df, cols, [0.25, 0.5, 0.75])
    out = {}
    for c in cols:
        q1, mid, q3 = quartiles[c]
        if mid is None:
            out[c] = F.lit(0.0)
        else:
            out[c] = (filled(c, medians).cast("double") - F.lit(mid)) / F.lit((q3 - q1) or 1.0)
    return out
