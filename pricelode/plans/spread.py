"""Parallelism for the stages that follow a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Redistribute a scan of fewer splits than cores by ``key``; larger tables are left as they are read."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan
