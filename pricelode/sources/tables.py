"""Reading and writing pricing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelode import schema
from pricelode.plans.durable import checkpointed


def load(spark: SparkSession, path: str, columns=None) -> DataFrame:
    """Read Parquet or CSV by suffix; CSV with an explicit schema when one is given."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(columns) if columns is not None else reader.option("inferSchema", True)).csv(path)
    raise ValueError(f"cannot read {path}: expected .parquet or .csv")


def save(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """Write ``df`` next to ``path`` with the suffix of its format and return where it went."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unsupported format {fmt!r}: expected 'parquet' or 'csv'")
    target = path if path.endswith(f".{fmt}") else f"{path}.{fmt}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target) if fmt == "parquet" else writer.option("header", True).csv(target)
    return target


def scan_pricing(spark: SparkSession, path: str) -> DataFrame:
    """A transaction table with its columns checked, missing numbers as nulls and a row id."""
    if path.rstrip("/").endswith(".csv"):
        # The columns of the file by name, with the types of the contract where it knows them.
        names = spark.read.option("header", True).csv(path).columns
        known = {f.name: f for f in schema.TRANSACTIONS.fields}
        df = load(spark, path, T.StructType([known.get(n, T.StructField(n, T.StringType())) for n in names]))
    else:
        df = with_row_id(load(spark, path))
    return prepared(df)


def with_row_id(df: DataFrame) -> DataFrame:
    """Rows of Parquet files by file and place, unless they have an id: part of the scan, and the same whenever it is run."""
    if "txn_id" in df.columns:
        return df
    file = F.hex(F.xxhash64("_metadata.file_path"))
    return df.select(F.concat_ws("-", file, F.col("_metadata.row_index").cast("string")).alias("txn_id"), *df.columns)


def prepared(df: DataFrame) -> DataFrame:
    df = schema.nan_to_null(schema.require_columns(df, [c for c in schema.REQUIRED if c != "txn_id"]))
    return df if "txn_id" in df.columns else with_txn_id(df)


def with_txn_id(df: DataFrame) -> DataFrame:
    """Give rows of any origin an id made of their content and, among equal rows, a number; written once to stay the same."""
    digest = F.substring(F.sha2(F.to_json(F.struct(*df.columns)), 256), 1, 24)
    # Equal rows are interchangeable, so lanes may split a large group of them at will.
    lane = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1_024))
    rows = df.withColumns({"_digest": digest, "_lane": lane})
    number = F.row_number().over(Window.partitionBy("_digest", "_lane").orderBy(F.lit(0)))
    numbered = rows.withColumn("txn_id", F.concat_ws("-", "_digest", F.col("_lane").cast("string"), number.cast("string")))
    return checkpointed(numbered.select("txn_id", *df.columns))


def save_results(results: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Anomaly results; Parquet is laid out by severity so that reports prune on it."""
    return save(results, path, fmt, ["severity"] if fmt == "parquet" else None)


def labelled_anomalies(df: DataFrame) -> DataFrame:
    return df.where("is_anomaly")


def star_schema(df: DataFrame) -> dict[str, DataFrame]:
    """Split the wide table into drugs, pharmacies, transactions and anomalies."""
    # Attributes are grouping keys first: smallest strings alone would make Spark sort all rows.
    drug = [c for c in ("drug_name", "ndc_code", "manufacturer", "drug_class") if c in df.columns]
    drugs = df.groupBy("drug_id", *drug).agg(F.min("wac_price").alias("low"), F.max("wac_price").alias("high")) \
        .groupBy("drug_id").agg(
            *[F.min(c).alias(c) for c in drug], F.min("low").alias("wac_low"), F.max("high").alias("wac_high"))
    # The commonest attributes of an id; the count also keeps the optimizer from dropping the first step.
    pharmacy = ["pharmacy_name", "pharmacy_chain", "state"]
    pharmacies = df.groupBy("pharmacy_id", *pharmacy).agg(F.count("*").alias("n")).groupBy("pharmacy_id") \
        .agg(F.min(F.struct((-F.col("n")).alias("n"), *pharmacy)).alias("a")) \
        .select("pharmacy_id", *[F.col(f"a.{c}").alias(c) for c in pharmacy])
    transactions = df.select(
        F.col("txn_id").alias("tx_id"), "drug_id", "pharmacy_id", "transaction_date",
        *schema.PRICES, "margin_percent", "volume_units", "is_anomaly", "anomaly_type",
    )
    anomalies = transactions.where("is_anomaly").select(
        "tx_id", "drug_id", "pharmacy_id", "anomaly_type", "actual_price", "wac_price",
        "margin_percent", "gtn_price", "volume_units", "transaction_date",
    )
    return {"drugs": drugs, "pharmacies": pharmacies, "transactions": transactions, "anomalies": anomalies}


def star_join(tables: dict[str, DataFrame]) -> DataFrame:
    """Facts with their drug and pharmacy attributes; the join strategy follows the sizes found at run time."""
    return (
        tables["transactions"]
        .join(tables["drugs"], "drug_id", "left")
        .join(tables["pharmacies"], "pharmacy_id", "left")
    )


def save_star(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    return {name: save(df, f"{folder.rstrip('/')}/{name}") for name, df in tables.items()}


def load_star(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        name: load(spark, f"{folder.rstrip('/')}/{name}.parquet")
        for name in ("drugs", "pharmacies", "transactions", "anomalies")
    }
