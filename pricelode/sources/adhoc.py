"""Read-only SQL over the star schema."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@contextmanager
def _views(spark: SparkSession, tables: dict[str, DataFrame]) -> Iterator[None]:
    """The tables as temporary views; the caller's views of the same names come back afterwards."""
    temporary = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    before = {name: spark.table(name) for name in tables if name in temporary}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        yield
    finally:
        for name in tables:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], max_rows: int | None = None) -> DataFrame:
    """The rows of a SELECT over ``tables``, all of them unless ``max_rows`` is given; anything else is refused."""
    text = sql.strip().rstrip(";").strip()
    first = text.split(None, 1)[0].lower() if text else ""
    if first not in ("select", "with"):
        raise ValueError(f"only SELECT queries are allowed, not {first.upper() or 'an empty statement'}")
    with _views(spark, tables):
        # A statement that writes does not parse in this position, also behind a WITH.
        rows = spark.sql(f"SELECT * FROM (\n{text}\n)")
    return rows if max_rows is None else rows.limit(max_rows)
