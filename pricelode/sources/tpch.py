"""Transactions derived from order-line tables (lineitem, part, supplier, nation, region)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.plans.spread import spread


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows are worked on one by one, on all cores even if it is a single file."""
    scan = table(spark, folder, name)
    return spread(scan, scan.columns[0])


def pricing_fact(spark: SparkSession, folder: str) -> DataFrame:
    """One transaction per order line; the joins are left to the optimizer, which prunes by the columns used."""
    line = spread_table(spark, folder, "lineitem")
    part, supplier, nation, region = (table(spark, folder, n) for n in ("part", "supplier", "nation", "region"))
    # Missing numbers are nulls before anything is derived from them.
    number = {
        c: F.nanvl(c, F.lit(None).cast("double"))
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    }
    wac = F.col("wac_price")
    returned = F.col("l_returnflag") == "R"
    return (
        line.withColumns(number)
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("wac_price", F.col("p_retailprice") * 2.2)
        .withColumns({
            "actual_price": F.try_divide("l_extendedprice", "l_quantity"),
            "asp_price": wac * (F.lit(0.92) + F.lit(1.5) * F.col("l_discount")),
            "amp_price": wac * (F.lit(0.82) + F.lit(0.6) * F.col("l_tax")),
            "price_340b": wac * (F.lit(0.67) + F.lit(0.6) * F.col("l_discount")),
            "gtn_price": wac * (F.lit(0.75) - F.lit(4) * F.col("l_discount")),
        })
        .select(
            F.concat_ws(
                "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                F.round(F.col("l_extendedprice") * 100).cast("bigint"),
            ).alias("txn_id"),
            F.col("l_partkey").alias("drug_id"),
            F.col("p_name").alias("drug_name"),
            F.concat(F.lit("NDC-"), F.col("l_partkey")).alias("ndc_code"),
            F.col("p_brand").alias("manufacturer"),
            F.col("p_type").alias("drug_class"),
            F.col("l_suppkey").alias("pharmacy_id"),
            F.col("s_name").alias("pharmacy_name"),
            F.col("r_name").alias("pharmacy_chain"),
            F.col("n_name").alias("state"),
            "wac_price", "asp_price", "amp_price", "price_340b", "gtn_price",
            (F.col("amp_price") * 1.03).alias("nadac_price"),
            "actual_price",
            (F.try_divide(F.col("asp_price") - F.col("actual_price"), F.col("asp_price")) * 100)
            .alias("margin_percent"),
            F.col("l_shipdate").cast("date").alias("transaction_date"),
            F.col("l_quantity").cast("bigint").alias("volume_units"),
            returned.alias("is_anomaly"),
            F.when(returned, "returned").alias("anomaly_type"),
        )
    )
