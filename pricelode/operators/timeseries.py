"""Detectors over the price sequence of a group, and the volume check per drug."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.plans.ordered import over_ordered

ORDER = ["transaction_date", "txn_id"]
MOVE_KEYS = ["drug_id", "pharmacy_id"]


def price_changes(df: DataFrame, **hot_options) -> DataFrame:
    """Relative change from the previous priced transaction of the same drug and pharmacy.

    Adds ``previous_price`` and ``price_change``. A row without a price carries the last
    price on, so it changes nothing itself and the next row compares with the price before it.
    """
    priced = over_ordered(
        df, MOVE_KEYS, ORDER, 1,
        lambda w: {"previous_price": F.lag("actual_price").over(w)},
        counts=F.col("actual_price").isNotNull(), **hot_options,
    )
    now, before = F.col("actual_price"), F.col("previous_price")
    # From zero the change is infinite by sign; zero to zero is no change at all.
    from_zero = F.when(now != 0, F.signum(now) * F.lit(float("inf")))
    return priced.withColumn("price_change", F.when(before == 0, from_zero).otherwise(now / before - 1))


def mom_flags(df: DataFrame, spike: float = 0.25, drop: float = 0.20, **hot_options) -> DataFrame:
    """Every row of ``df`` with ``mom_type`` and ``mom_score``, null where the price did not jump."""
    change = F.col("price_change")
    kind = F.when(change > spike, "mom_spike").when(change < -drop, "mom_drop")
    limit = F.when(change > spike, F.lit(spike * 4)).otherwise(F.lit(drop * 4))
    return price_changes(df, **hot_options).withColumns({
        "mom_type": kind,
        "mom_score": F.when(kind.isNotNull(), F.least(F.abs(change) / limit, F.lit(1.0))),
    })


def rolling_zscore(
    df: DataFrame,
    value: str = "actual_price",
    keys: list[str] = ["drug_id"],
    window: int = 12,
    threshold: float = 3.0,
    **hot_options,
) -> DataFrame:
    """z of each row against the last ``window`` rows of its group, itself included."""
    def add(w):
        frame = w.rowsBetween(-(window - 1), 0)
        return {"rolling_mean": F.avg(value).over(frame), "rolling_std": F.stddev_samp(value).over(frame)}

    rows = over_ordered(df, keys, ORDER, window - 1, add, **hot_options)
    z = F.when(F.col("rolling_std") < 1e-9, 0.0).otherwise(
        (F.col(value) - F.col("rolling_mean")) / F.col("rolling_std"))
    return rows.withColumn("z", F.coalesce(z, F.lit(0.0))).withColumn("is_spike", F.abs("z") > threshold)


def volume_outliers(df: DataFrame, sigmas: float = 4.0) -> DataFrame:
    """Rows whose volume exceeds their drug's mean by ``sigmas`` standard deviations."""
    stats = df.groupBy("drug_id").agg(
        F.avg("volume_units").alias("volume_mean"),
        F.coalesce(F.stddev_samp("volume_units"), F.lit(1.0)).alias("volume_std"),
    )
    # An equi-join instead of a window: a hot drug is split by the skew join.
    return df.join(stats, "drug_id").where(
        F.col("volume_units") > F.col("volume_mean") + F.lit(sigmas) * F.col("volume_std"))
