"""Ordered windows over groups of any size.

A window by key puts a whole key into one task, so a key that holds a large share of the
rows would run alone. Such keys are found on a sample of the key columns (the sample only
decides the route, both routes give the same answer). Then the rows are written once, hot ones apart
and cut into spans of days that hold many times the rows a frame looks back on, one day at least; each span
gets the few preceding rows of the one before. A key that fills a single span is not cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pricelode.plans.durable import checkpointed

LANES = 4_096
#: Hot keys are found on one in so many rows.
ONE_IN = 1_000
#: Rows of a slice, as a multiple of the rows that it gets from the one before.
SLICE_ROWS = 16


def is_sampled(row_id: str, one_in: int = ONE_IN) -> Column:
    """Whether hot keys are sought on a row."""
    return F.pmod(F.xxhash64(row_id), F.lit(one_in)) == 0


def find_hot_keys(
    df: DataFrame, keys: list[str], row_id: str, one_in: int = ONE_IN, min_sampled: int = 1_000, counted: bool = False,
    sampled: DataFrame | None = None,
) -> DataFrame | None:
    """Keys with about ``one_in * min_sampled`` rows or more; None if there are none. There are at most as many as the
    table has rows for; they are written once and joined like any table, if ``counted`` with the number ``n`` of their sampled rows.
    ``sampled`` has the keys of the sampled rows where they are at hand (its other rows have nulls), which saves a pass over ``df``."""
    if sampled is None:
        sampled = df if one_in == 1 else df.where(is_sampled(row_id, one_in))
    rows = (
        sampled.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_sampled)
    )
    found = checkpointed(rows if counted else rows.select(*keys))
    return None if found.isEmpty() else found


def over_ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    lookback: int,
    add: Callable[[WindowSpec], dict[str, Column]],
    counts: Column | None = None,
    row_id: str = "txn_id",
    slice_by: str = "transaction_date",
    slice_rows: int | None = None,
    **hot_options,
) -> DataFrame:
    """Add window columns whose frames reach at most ``lookback`` rows back.

    ``order`` must be a total order whose first column is ``slice_by``. Rows with a null key, or for
    which ``counts`` is false, belong to no sequence: they stay, with nulls in the new columns,
    and are spread over lanes of their own. A slice of a hot key has about ``slice_rows`` rows (by default SLICE_ROWS times
    ``lookback``), or those of a day where these are more.
    """
    takes_part = F.lit(True) if counts is None else F.coalesce(counts, F.lit(False))
    for key in keys:
        takes_part = takes_part & F.col(key).isNotNull()
    spread_out = F.pmod(F.xxhash64(row_id), F.lit(LANES)).cast("int")
    source_columns = df.columns
    laned = df.withColumn("_lane", F.when(takes_part, F.lit(-1)).otherwise(spread_out))
    in_sequence = F.col("_lane") == -1

    def windowed(rows: DataFrame, by: list[str]) -> DataFrame:
        added = add(Window.partitionBy(*by, "_lane").orderBy(*order))
        return rows.withColumns(added).withColumns({c: F.when(in_sequence, F.col(c)) for c in added})

    hot = find_hot_keys(df, keys, row_id, counted=True, **hot_options)
    if hot is None:
        return windowed(laned, keys).drop("_lane")

    # One pass over the input: what follows reads the written rows, hot and cold ones from different folders.
    one_in = hot_options.get("one_in", ONE_IN)
    hot = hot.select(*keys, (F.col("n") * one_in).alias("_rows"))
    marked = laned.join(hot, keys, "left").select(*source_columns, "_lane", "_rows", F.col("_rows").isNotNull().alias("_hot"))
    staged = checkpointed(marked, ["_hot"])
    cold_part = windowed(staged.where(~F.col("_hot")).drop("_hot", "_rows"), keys).drop("_lane")

    # Keys of several slices; the days of most of their rows tell how many days a slice spans.
    wanted = max(1, SLICE_ROWS * lookback if slice_rows is None else slice_rows)
    rows = staged.where("_hot").drop("_hot")
    day = F.unix_date(F.to_date(slice_by))
    middle = F.percentile_approx(day, F.array(F.lit(0.05), F.lit(0.95)), F.lit(1_000))
    span = F.get("middle", F.lit(1)) - F.get("middle", F.lit(0)) + 1
    sampled = rows if one_in == 1 else rows.where(is_sampled(row_id, one_in))
    cut = checkpointed(sampled.where(F.col("_rows") > 2 * wanted).groupBy(*keys, "_rows").agg(middle.alias("middle")).select(
        *keys, F.greatest(F.lit(1), F.floor(span * wanted / F.col("_rows"))).cast("int").alias("_width")))
    rows = rows.drop("_rows")
    if cut.isEmpty():
        return cold_part.unionByName(windowed(rows, keys).drop("_lane"))
    rows = rows.join(cut, keys, "left").select(*source_columns, "_lane", "_width").withColumn(
        "_slice", F.when(F.col("_width").isNull(), 0).otherwise(F.floor(day / F.col("_width"))))
    in_cut = rows.where(in_sequence & F.col("_width").isNotNull()).drop("_width")
    rows = rows.drop("_width")
    newest_first = Window.partitionBy(*keys, "_slice").orderBy(*[F.desc(c) for c in order])
    tails = in_cut.withColumn("_r", F.row_number().over(newest_first)) \
        .where(F.col("_r") <= lookback).drop("_r")
    in_key = Window.partitionBy(*keys).orderBy(*order)
    in_slice = Window.partitionBy(*keys, "_slice").orderBy(*order)
    carried = (
        tails.withColumn("_before", F.collect_list(F.struct(*source_columns)).over(in_key.rowsBetween(-lookback, -1)))
        .withColumn("_r", F.row_number().over(in_slice)).where(F.col("_r") == 1)
        .select(F.col("_slice").alias("_to"), F.explode("_before").alias("_b"))
        .select("_b.*", F.lit(-1).alias("_lane"), F.col("_to").alias("_slice"), F.lit(True).alias("_carried"))
    )
    hot_part = windowed(
        rows.withColumn("_carried", F.lit(False)).unionByName(carried), [*keys, "_slice"],
    ).where(~F.col("_carried")).drop("_slice", "_carried", "_lane")
    return cold_part.unionByName(hot_part)
