"""Approximate nearest vectors: hash tables of random projections, several probes, exact scores.

Each table cuts space with random orthogonal planes through the mean of the store; the sides on which a vector lies are the bits
of its bucket. A query looks into its own bucket of every table and into the buckets across the planes that it is closest to.
What is found there is scored exactly.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.text.search import STORE_ROWS_PER_CELL, best_in_cells, matrix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TABLES = 6
PROBES = 8  # buckets per table and query
ROWS_PER_BUCKET = 200
MAX_BITS = 24
#: Planes a probe may cross: the subsets of this many nearest ones are weighed.
NEAREST_PLANES = 8
#: Buckets that are named in the scan's filter; more of them are left to a semi join.
NAMED_BUCKETS = 1_024


@dataclass
class Planes:
    """``normals`` (tables, bits, dimensions) and the ``offsets`` (tables, bits) of the planes along them."""

    normals: np.ndarray
    offsets: np.ndarray

    def sides(self, x: np.ndarray) -> np.ndarray:
        """``(rows, tables, bits)``: signed distances to the planes."""
        return np.einsum("nd,tbd->ntb", x, self.normals) - self.offsets

    def buckets(self, x: np.ndarray) -> np.ndarray:
        return (self.sides(x) > 0) @ (1 << np.arange(self.offsets.shape[1], dtype=np.int64))

    def probes(self, x: np.ndarray, most: int) -> np.ndarray:
        """``(rows, tables, probes)``: a query's own bucket first, then those whose planes are nearest by squared distance."""
        sides = self.sides(x)
        rows, tables, bits = sides.shape
        own = (sides > 0) @ (1 << np.arange(bits, dtype=np.int64))
        width = min(NEAREST_PLANES, bits)
        near = np.argsort(np.abs(sides), axis=2, kind="stable")[:, :, :width]
        cost = np.take_along_axis(sides, near, axis=2) ** 2
        subsets = (np.arange(1 << width)[:, None] >> np.arange(width)) & 1
        best = np.argsort(cost @ subsets.T, axis=2, kind="stable")[:, :, :most]
        flips = np.einsum("ntpw,ntw->ntp", subsets[best], np.int64(1) << near)
        return own[:, :, None] ^ flips


@dataclass
class HashIndex:
    """``postings`` (table, bucket, id, keys, vector), the ``sizes`` (table, bucket, rows) of all buckets, and the planes."""

    postings: DataFrame
    sizes: DataFrame
    planes: Planes


def random_planes(store: DataFrame, vector: str = "embedding", tables: int = TABLES, rows_per_bucket: int = ROWS_PER_BUCKET,
                  seed: int = 0) -> Planes:
    """Planes for a store: as many as give buckets of about ``rows_per_bucket`` rows. One aggregation."""
    held = store.where(F.col(vector).isNotNull())
    if held.isEmpty():
        raise ValueError("there are no vectors to index")
    n, mean = held.agg(F.count("*"), Summarizer.mean(array_to_vector(vector))).first()
    mean = np.asarray(mean.toArray())
    bits = max(1, min(MAX_BITS, len(mean), round(math.log2(max(2.0, n / rows_per_bucket)))))
    r = np.random.default_rng(seed)
    normals = np.stack([np.linalg.qr(r.normal(size=(len(mean), bits)))[0].T for _ in range(tables)])
    return Planes(normals, normals @ mean)


def build_hashes(store: DataFrame, path: str, id_col: str = "chunk_id", vector: str = "embedding", keys: Sequence[str] = (),
                 planes: Planes | None = None, **options) -> HashIndex:
    """Writes every vector once per table, in the order of its bucket, with the planes and the bucket sizes next to it."""
    planes = planes or random_planes(store, vector, **options)
    spark = store.sparkSession
    rows = store.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), *keys, F.col(vector).alias("vector"))
    types = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                buckets = planes.buckets(matrix(b["vector"]))
                for t in range(buckets.shape[1]):
                    yield b.assign(table=t, bucket=buckets[:, t])

    placed = rows.mapInPandas(hashed, f"{types}, table int, bucket long")
    placed.repartitionByRange("table", "bucket", "id").sortWithinPartitions("table", "bucket").write.mode("overwrite").partitionBy(
        "table").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("table", "bucket").agg(F.count("*").alias("rows")).write.mode(
        "overwrite").parquet(f"{path}/sizes")
    tables, bits, _ = planes.normals.shape
    spark.createDataFrame(
        [(t, b, planes.normals[t, b].tolist(), float(planes.offsets[t, b])) for t in range(tables) for b in range(bits)],
        "table int, bit int, normal array<double>, offset double").coalesce(1).write.mode("overwrite").parquet(f"{path}/planes")
    return load_hashes(spark, path)


def load_hashes(spark: SparkSession, path: str) -> HashIndex:
    try:
        planes = spark.read.parquet(f"{path}/planes").orderBy("table", "bit").collect()  # tables * MAX_BITS rows at most
        postings, sizes = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/sizes")
    except AnalysisException as missing:
        raise FileNotFoundError(f"no hash tables at {path}: build them first") from missing
    tables = planes[-1]["table"] + 1
    return HashIndex(postings, sizes, Planes(
        np.array([r["normal"] for r in planes]).reshape(tables, len(planes) // tables, -1),
        np.array([r["offset"] for r in planes]).reshape(tables, -1)))


def probed(index: HashIndex, queries: DataFrame, vector: str = "embedding", query_id: str = "query_id", probes: int = PROBES) -> DataFrame:
    """``query_id, vector, table, bucket, rows``: the buckets that each query looks into, as far as they hold anything."""
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(vector).alias("vector"))
    planes = index.planes

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                buckets = planes.probes(matrix(b["vector"]), probes)
                n, tables, each = buckets.shape
                yield b.loc[b.index.repeat(tables * each)].assign(
                    table=np.tile(np.repeat(np.arange(tables), each), n).astype(np.int32), bucket=buckets.ravel())

    types = ", ".join(f"`{c}` {t}" for c, t in asked.dtypes)
    return asked.mapInPandas(probe, f"{types}, table int, bucket long").join(index.sizes, ["table", "bucket"])


def approximate_top_k(
    index: HashIndex, queries: DataFrame, k: int = 4, vector: str = "embedding", query_id: str = "query_id", probes: int = PROBES,
    rows_per_cell: int = STORE_ROWS_PER_CELL,
) -> DataFrame:
    """``query_id, id, *keys, similarity, place``: the ``k`` best rows that the probes of each query find, scored exactly.

    Buckets of more than ``rows_per_cell`` rows, such as those of many equal vectors, are dealt over several cells. Recall
    depends on the data: more tables and probes raise it.
    """
    visits = probed(index, queries, vector, query_id, probes)
    buckets = visits.select("table", "bucket", "rows").distinct()
    some = buckets.limit(NAMED_BUCKETS + 1).collect()
    store = index.postings
    if len(some) <= NAMED_BUCKETS:
        store = store.where(F.col("bucket").isin([r["bucket"] for r in some]) & F.col("table").isin([r["table"] for r in some]))
    salts = F.ceil(F.col("rows") / rows_per_cell).cast("int")
    store = store.join(buckets, ["table", "bucket"]).withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).drop("rows")
    visits = visits.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("rows")
    names = [c for c in store.columns if c not in ("table", "bucket", "salt", "vector")]
    types = dict(store.dtypes)
    schema = f"query_id {dict(visits.dtypes)['query_id']}, " + ", ".join(f"`{c}` {types[c]}" for c in names) + ", similarity double"
    hits = best_in_cells(store, visits, k, ("table", "bucket", "salt"), schema).dropDuplicates(["query_id", *names])
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), *names)
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
