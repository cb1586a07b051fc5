"""Before and after comparison of each drug, split at the middle of its transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.plans.durable import checkpointed

STABLE_BELOW = 5.0
MEASURES = ["actual_price", "margin_percent"]


def _sums() -> list[Column]:
    """Additive parts of the means and bounds."""
    return [
        *[F.sum(m).alias(f"sum_{m}") for m in MEASURES], *[F.count(m).alias(f"n_{m}") for m in MEASURES],
        F.min("transaction_date").alias("start"), F.max("transaction_date").alias("end"), F.count("*").alias("n"),
    ]


def causal_summary(df: DataFrame) -> DataFrame:
    """Means before and after, their change, the trend and the price volatility per drug.

    The first half of a drug's rows by (date, txn_id) is the period before. Rows are summed
    per drug and day first, which puts whole days on one side; only the day in which the
    middle falls is ordered row by row, so no task ever sorts a whole drug.
    """
    dated = df.withColumn("day", F.to_date("transaction_date"))
    # One row per drug and day (more only if its name varies), written once: it is read several times.
    daily = checkpointed(dated.groupBy("drug_id", "drug_name", "day").agg(
        *_sums(), F.var_pop("actual_price").alias("spread")))
    drug = Window.partitionBy("drug_id")
    through = F.sum("n").over(drug.orderBy("day").rangeBetween(Window.unboundedPreceding, 0))
    priced, total = F.col("n_actual_price"), F.sum("n_actual_price").over(drug)
    mean = F.try_divide(F.sum("sum_actual_price").over(drug), total)
    # The drug's variance from the variances and means of its days.
    off = F.try_divide(F.col("sum_actual_price"), priced) - F.col("mean")
    squares = F.sum(priced * (F.col("spread") + off * off)).over(drug)
    placed = daily.withColumns({
        "through": through, "middle": F.floor(F.sum("n").over(drug) / 2), "mean": mean, "priced": total,
        "day_n": F.sum("n").over(Window.partitionBy("drug_id", "day")),
    }).withColumn("volatility", F.when(F.col("priced") > 1, F.sqrt(squares / (F.col("priced") - 1))))
    left = F.col("middle") - (F.col("through") - F.col("day_n"))  # rows of the day that come before the middle
    whole = placed.where((left <= 0) | (left >= F.col("day_n"))).withColumn("is_pre", left >= F.col("day_n"))
    split = placed.where((left > 0) & (left < F.col("day_n"))) \
        .select("drug_id", "day", left.alias("pre_rows"), "volatility").distinct()

    order = Window.partitionBy("drug_id", "day").orderBy("transaction_date", "txn_id")
    parts = (
        dated.join(split, ["drug_id", "day"])
        .withColumn("is_pre", F.row_number().over(order) <= F.col("pre_rows"))
        .groupBy("drug_id", "is_pre").agg(*_sums(), F.max("volatility").alias("volatility"))
    )
    columns = ["drug_id", "is_pre", *[f"{a}_{m}" for a in ("sum", "n") for m in MEASURES], "start", "end", "n", "volatility"]
    both = whole.select(*columns).unionByName(parts.select(*columns))

    def side(flag: Column, name: str) -> list[Column]:
        total = {m: F.sum(F.when(flag, F.col(f"sum_{m}"))) for m in MEASURES}
        count = {m: F.sum(F.when(flag, F.col(f"n_{m}"))) for m in MEASURES}
        return [
            *[F.try_divide(total[m], count[m]).alias(f"{name}_{m}") for m in MEASURES],
            F.min(F.when(flag, F.col("start"))).alias(f"{name}_start"),
            F.max(F.when(flag, F.col("end"))).alias(f"{name}_end"),
        ]

    pre = F.col("is_pre")
    compared = both.groupBy("drug_id").agg(
        F.sum("n").alias("transactions"), *side(pre, "pre"), *side(~pre, "post"), F.max("volatility").alias("volatility"))
    names = daily.groupBy("drug_id").agg(F.min("drug_name").alias("drug_name"))

    def change(m: str, base: Column) -> Column:
        moved = (F.col(f"post_{m}") - F.col(f"pre_{m}")) / base * 100
        return F.when(F.col(f"pre_{m}") == 0, F.lit(0.0)).when(F.col(f"pre_{m}").isNotNull(), moved)

    price = change("actual_price", F.col("pre_actual_price"))
    margin = change("margin_percent", F.abs("pre_margin_percent"))
    trend = F.when(F.abs("price_change_pct") < STABLE_BELOW, "stable") \
        .when(F.col("price_change_pct") > 0, "increasing").when(F.col("price_change_pct") <= 0, "decreasing")
    return compared.join(names, "drug_id").withColumns(
        {"price_change_pct": price, "margin_change_pct": margin}).withColumn("trend", trend)
