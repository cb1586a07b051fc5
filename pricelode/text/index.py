"""A stored index: chunks with their metadata and vectors as one Parquet table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from pricelode.plans.spread import spread


def save_index(chunks: DataFrame, path: str) -> DataFrame:
    """Write ``chunk_id, ..., text, metadata, embedding`` and return it as stored."""
    chunks.write.mode("overwrite").parquet(path)
    return load_index(chunks.sparkSession, path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spread(spark.read.parquet(path), "chunk_id")
    except AnalysisException as missing:
        raise FileNotFoundError(f"no index at {path}: build it first") from missing
