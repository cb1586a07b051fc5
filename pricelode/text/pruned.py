"""An exact vector index that is read in part: cells around centroids, left out where no row of them can be among the best.

The vectors lie in one Parquet partition per cell. With each cell are kept its centroid and how far its rows are from it, as
distance and as angle, and the greatest length of a row. For a query q and a row x of a cell with centroid c, q*x is at most
q*c + |q| r, and at most |q| |x| cos(a) for the angle a that is left between q and the cone of the cell.
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
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelode.text.search import STORE_ROWS_PER_CELL, best_in_cells, matrix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_CELLS = 1_024  # also bounds what of the index is held by the driver and every task: their centroids
SAMPLES_PER_CELL, ROUNDS = 48, 6
#: Scores are rounded to twelve digits; bounds have to be wrong by more than that before a cell is left out.
SLACK = 1e-9


@dataclass
class Cells:
    """Centroids, rows, radius, angle (of the cone around the centroid) and longest row of each cell."""

    number: np.ndarray
    centroid: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    angle: np.ndarray
    longest: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """``(queries, cells)``: what no row of a cell scores more than."""
        length, size = np.linalg.norm(q, axis=1)[:, None], np.linalg.norm(self.centroid, axis=1)
        product = q @ self.centroid.T
        ball = product + length * self.radius
        between = np.arccos(np.clip(product / np.maximum(length * size, 1e-300), -1, 1))
        apart = np.where((length > 0) & (size > 0), np.maximum(0, between - self.angle), 0)
        return np.minimum(ball, length * self.longest * np.maximum(0, np.cos(apart))) + SLACK * (1 + length * self.longest)


@dataclass
class PrunedIndex:
    """``vectors`` (cell, id, keys, vector), partitioned by cell, and what is known of the cells."""

    vectors: DataFrame
    cells: Cells


def centroids(sample: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """``cells`` centres of a bounded sample, or as many as there are different rows: Lloyd's rounds from random rows."""
    sample = np.unique(sample, axis=0)
    r = np.random.default_rng(seed)
    centre = sample[np.sort(r.permutation(len(sample))[:cells])]
    for _ in range(ROUNDS):
        own = closest(sample, centre)
        count = np.bincount(own, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, own, sample)
        centre = np.where(count[:, None] > 0, total / np.maximum(1, count)[:, None], centre)
    return centre


def closest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmin((centre**2).sum(axis=1) - 2 * (x @ centre.T), axis=1)


def build_pruned(store: DataFrame, path: str, id_col: str = "chunk_id", vector: str = "embedding", keys: Sequence[str] = (),
                 cells: int | None = None, rows_per_file: int = 100_000, seed: int = 0) -> PrunedIndex:
    """Writes the index of all rows that have a vector. The centroids come from at most ``2 * SAMPLES_PER_CELL * cells`` rows,
    drawn by a hash of the id; they only shape the cells, what a search finds does not depend on them."""
    spark = store.sparkSession
    rows = store.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), *keys, F.col(vector).alias("vector"))
    n = rows.count()
    if not n:
        raise ValueError("there are no vectors to index")
    wanted = min(MAX_CELLS, cells or max(1, round(math.sqrt(n))))
    share = min(1.0, 1.5 * SAMPLES_PER_CELL * wanted / n)
    drawn = rows.where(F.xxhash64("id", *keys, F.lit(seed)) <= min(2**63 - 1, int(-(2**63) + share * 2**64)))
    sample = drawn.select("vector").limit(2 * SAMPLES_PER_CELL * wanted).toPandas()
    sample = sample if len(sample) else rows.select("vector").limit(1).toPandas()
    centre = centroids(matrix(sample["vector"]), wanted, seed)
    size = np.linalg.norm(centre, axis=1)
    types = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = matrix(b["vector"])
                own = closest(x, centre)
                length = np.linalg.norm(x, axis=1)
                cosine = (x * centre[own]).sum(axis=1) / np.maximum(length * size[own], 1e-300)
                angle = np.where((length > 0) & (size[own] > 0), np.arccos(np.clip(cosine, -1, 1)), 0.0)
                yield b.assign(cell=own.astype(np.int32), away=np.linalg.norm(x - centre[own], axis=1), angle=angle, length=length)

    placed = rows.mapInPandas(place, f"{types}, cell int, away double, angle double, length double")
    files = max(1, math.ceil(n / (len(centre) * rows_per_file)))
    placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(files))).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    known = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg(
        F.count("*").alias("rows"), F.max("away").alias("radius"), F.max("angle").alias("angle"), F.max("length").alias("longest")).collect()
    spark.createDataFrame([(*r, centre[r["cell"]].tolist()) for r in known],  # MAX_CELLS rows at most
                          "cell int, rows long, radius double, angle double, longest double, centroid array<double>").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/cells")
    return load_pruned(spark, path)


def load_pruned(spark: SparkSession, path: str) -> PrunedIndex:
    try:
        known = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        vectors = spark.read.parquet(f"{path}/vectors").drop("away", "angle", "length")
    except AnalysisException as missing:
        raise FileNotFoundError(f"no index at {path}: build it first") from missing
    column = lambda name: np.array([r[name] for r in known])
    return PrunedIndex(vectors, Cells(*map(column, ("cell", "centroid", "rows", "radius", "angle", "longest"))))


def pruned_top_k(
    index: PrunedIndex, queries: DataFrame, k: int = 4, vector: str = "embedding", query_id: str = "query_id",
    rows_per_cell: int = STORE_ROWS_PER_CELL,
) -> DataFrame:
    """``query_id, id, *keys, similarity, place``: the ``k`` best rows per query (all of them if fewer), as an exact search has them.

    A query first visits the most promising cells that hold ``k`` rows; their k-th best score is what a row has to reach. Then
    it visits the other cells whose bound does. Only visited cells are read.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(vector).alias("vector"))
    first = _found(index, _visits(index.cells, asked, k), k, rows_per_cell)
    reached = first.where(F.col("place") == k).select(F.col("query_id").alias("q"), F.col("similarity").alias("least"))
    rest = asked.join(reached, F.col("query_id").eqNullSafe(F.col("q")), "left").drop("q")
    return _best(first.drop("place").unionByName(_found(index, _visits(index.cells, rest, k), k, rows_per_cell).drop("place")), k)


def _visits(cells: Cells, asked: DataFrame, k: int) -> DataFrame:
    """``query_id, vector, cell, rows``: the first visits of queries, or the others that can reach ``least`` if that column is there."""
    further = "least" in asked.columns

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            q = matrix(b["vector"])
            bound = cells.bounds(q)
            order = np.argsort(-(q @ cells.centroid.T), axis=1, kind="stable")
            held = np.cumsum(cells.rows[order], axis=1) - cells.rows[order]
            visit = np.zeros(bound.shape, bool)
            np.put_along_axis(visit, order, held < k, axis=1)  # until k rows are there
            if further:
                visit = ~visit & (bound >= b["least"].fillna(-np.inf).to_numpy()[:, None])
            row, cell = np.nonzero(visit)
            yield b.iloc[row][["query_id", "vector"]].assign(cell=cells.number[cell].astype(np.int32), rows=cells.rows[cell])

    types = dict(asked.dtypes)
    return asked.mapInPandas(choose, f"query_id {types['query_id']}, vector {types['vector']}, cell int, rows long")


def read_cells(index: PrunedIndex, visits: DataFrame) -> DataFrame:
    """The part of the index that is visited, chosen by directory."""
    cells = [r["cell"] for r in visits.select("cell").distinct().collect()]  # MAX_CELLS at most
    return index.vectors.where(F.col("cell").isin(cells)) if cells else index.vectors.where(F.lit(False))


def _found(index: PrunedIndex, visits: DataFrame, k: int, rows_per_cell: int) -> DataFrame:
    """Large cells are dealt over several, each of which their queries visit."""
    rows = dict(zip(index.cells.number.tolist(), index.cells.rows.tolist(), strict=True))
    parts = {c: math.ceil(n / rows_per_cell) for c, n in rows.items() if n > rows_per_cell}
    store = read_cells(index, visits)
    salts = F.lit(1)
    if parts:
        salts = F.coalesce(F.create_map(*(F.lit(x) for pair in parts.items() for x in pair))[F.col("cell")], F.lit(1))
    store = store.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int"))
    visits = visits.drop("rows").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    names = [c for c in store.columns if c not in ("cell", "salt", "vector")]
    types = dict(store.dtypes)
    schema = f"query_id {dict(visits.dtypes)['query_id']}, " + ", ".join(f"`{c}` {types[c]}" for c in names) + ", similarity double"
    return _best(best_in_cells(store, visits, k, ("cell", "salt"), schema), k)


def _best(hits: DataFrame, k: int) -> DataFrame:
    names = [c for c in hits.columns if c not in ("query_id", "similarity")]
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), *names)
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
