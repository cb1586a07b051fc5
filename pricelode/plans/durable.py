"""Cutting lineage through storage every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only in local mode."""
    sc = spark.sparkContext
    configured = spark.conf.get(_CONF, None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="run-")
    sc.setCheckpointDir(folder)
    return folder


#: Folders of the steps this process wrote.
_STEPS: list[str] = []


#: Writers otherwise count rows, a hundred at least, before they look at their size, and readers take a row group at once.
_LARGE_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """While this holds, a finished query leaves no shuffle files; what is read again must have been written."""
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, before)


def checkpointed(df: DataFrame, partition_by: Sequence[str] = (), large_rows: bool = False) -> DataFrame:
    """Write ``df`` once as a table; what follows reads the columns it needs and survives lost executors. The shuffles that made
    it are freed.

    Rows of megabytes are ``large_rows``: a task then holds few of them at a time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    _STEPS.append(path)
    with freeing(spark):
        df.write.options(**(_LARGE_ROWS if large_rows else {})).partitionBy(*partition_by).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored = stored.select(*df.columns) if partition_by else stored
    stored._step = path
    return stored


def discard(*steps: DataFrame) -> None:
    """Deletes steps that ``checkpointed`` gave, once all that is read from them has been written or collected."""
    for step in steps:
        _STEPS.remove(step._step)
        _delete(step.sparkSession, step._step)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_steps(spark: SparkSession) -> int:
    """Deletes the steps that this process wrote, once their results have been stored elsewhere; returns how many.

    Frames that were built on them can't be read afterwards.
    """
    removed = 0
    while _STEPS:
        removed += _delete(spark, _STEPS.pop())
    return removed


def _delete(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
