"""Exact nearest vectors by dot product, for batches of queries."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_BROADCAST_QUERIES = 1_024
STORE_ROWS_PER_CELL = 20_000
VISITS = 512  # queries scored together with a cell
PAIRS = 8_192  # summed at a time
DIGITS = 12  # scores are compared after rounding, so that equal vectors tie wherever they are


def best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` highest scores per query, ties to the lower id, then to the lower of the columns after it."""
    after = [c for c in found.columns if c not in ("query", "score")]
    ordered = found.sort_values(["query", "score", *after], ascending=[True, False, *[True] * len(after)], kind="stable")
    return ordered[ordered.groupby("query").cumcount() < k]


def score(ids: pd.DataFrame, store: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best rows per query. A product of matrices differs in its last bits with their shapes, so it only picks the rows
    that may count; their scores are summed pair by pair, and are the same in any batch."""
    sims = store @ queries.T
    if len(sims) > k:
        floor = np.partition(sims, len(sims) - k, axis=0)[len(sims) - k]
        longest = np.sqrt((store ** 2).sum(axis=1).max()) * np.sqrt((queries ** 2).sum(axis=1))
        off = 2 * 10.0 ** -DIGITS + 4 * store.shape[1] * np.finfo(float).eps * longest
        row, query = np.nonzero(sims >= floor - np.where(np.isfinite(off), off, 0.0))
    else:
        row, query = np.nonzero(np.isfinite(sims))
    sums = [np.einsum("ij,ij->i", store[row[i:i + PAIRS]], queries[query[i:i + PAIRS]]) for i in range(0, len(row), PAIRS)]
    return best(ids.iloc[row].reset_index(drop=True).assign(query=query, score=np.round(np.concatenate([*sums, []]), DIGITS)), k)


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def top_k(
    store: DataFrame, queries: DataFrame, k: int = 4,
    id_col: str = "chunk_id", vector: str = "embedding", query_id: str = "query_id",
    max_broadcast: int = MAX_BROADCAST_QUERIES, rows_per_cell: int = STORE_ROWS_PER_CELL, keys: Sequence[str] = (),
) -> DataFrame:
    """``query_id, id, *keys, similarity, place``: the ``k`` best rows per query (all of them if fewer).

    ``keys`` are columns of the store that come along with the id, for ids that do not tell all rows apart.

    A batch of at most ``max_broadcast`` queries is sent to every task, which reads its part of the
    store once and returns k rows per query. The queries of a larger batch visit every cell of the store,
    each of whose rows is in one cell.
    """
    store = store.where(F.col(vector).isNotNull()).select(
        F.col(id_col).alias("id"), *keys, F.col(vector).alias("vector"))
    queries = queries.where(F.col(vector).isNotNull()).select(
        F.col(query_id).alias("query_id"), F.col(vector).alias("vector"))
    query_type = dict(queries.dtypes)["query_id"]
    schema = f"query_id {query_type}, " + ", ".join(f"`{c}` {t}" for c, t in store.drop("vector").dtypes) + ", similarity double"
    few = queries.limit(max_broadcast + 1).toPandas()
    if len(few) <= max_broadcast:
        scored = _against_broadcast(store, few, k, schema)
    else:
        scored = _in_cells(store, queries, k, schema, rows_per_cell)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id", *keys)
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _against_broadcast(store: DataFrame, few: pd.DataFrame, k: int, schema: str) -> DataFrame:
    if not len(few):
        return store.sparkSession.createDataFrame([], schema)
    names = few["query_id"].to_numpy()
    shared = store.sparkSession.sparkContext.broadcast(matrix(few["vector"]))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = None
        for b in batches:
            if len(b):
                hits = score(b.drop(columns="vector"), matrix(b["vector"]), shared.value, k)
                top = hits if top is None else best(pd.concat([top, hits], ignore_index=True), k)
        if top is not None:
            yield _hits(top, names)

    return store.mapInPandas(scan, schema)


def _hits(top: pd.DataFrame, names: np.ndarray) -> pd.DataFrame:
    out = top.drop(columns=["query", "score"]).assign(similarity=top["score"])
    out.insert(0, "query_id", names[top["query"]])
    return out


def _in_cells(
    store: DataFrame, queries: DataFrame, k: int, schema: str, per_cell: int,
) -> DataFrame:
    """Every query visits every cell; a row of the store is in one cell only."""
    cells = max(1, math.ceil(store.count() / per_cell))
    placed = store.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int"))
    visits = queries.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    return best_in_cells(placed, visits, k, ("cell",), schema)


def best_in_cells(store: DataFrame, visits: DataFrame, k: int, cell: Sequence[str], schema: str) -> DataFrame:
    """``query_id, id, *keys, similarity``: the ``k`` best rows of each visited cell for each visit.

    ``store`` has the columns of ``cell``, the id and keys of ``schema``, and ``vector``; ``visits`` has those of ``cell``,
    ``query_id`` and ``vector``. A cell's rows of the store come first and are held, so their number has to be bounded; its
    visits, of which there may be any number, stream past them.
    """
    ids = [c for c in store.columns if c not in (*cell, "vector")]
    rows = store.select(*cell, F.lit(0).alias("_side"), *ids, F.lit(None).cast(dict(visits.dtypes)["query_id"]).alias("query_id"), "vector")
    asks = visits.select(*cell, F.lit(1).alias("_side"), *(F.lit(None).cast(t).alias(c) for c, t in store.select(*ids).dtypes),
                         "query_id", "vector")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at, known, vectors = [], None, None, None
        for b in batches:
            if not len(b):
                continue
            where = b[list(cell)]
            new = np.flatnonzero((where != where.shift()).any(axis=1).to_numpy())
            for start, end in zip(new, [*new[1:], len(b)], strict=True):
                part, here = b.iloc[start:end], tuple(where.iloc[start])
                if here != at:
                    held, at, known = [], here, None
                side = part["_side"].to_numpy()
                if (side == 0).any():
                    held.append(part[side == 0])
                asked = part[side == 1]
                if len(asked) and held:
                    if known is None:
                        known = pd.concat(held)
                        known, vectors = known[ids].reset_index(drop=True), matrix(known["vector"])
                    for first in range(0, len(asked), VISITS):
                        some = asked.iloc[first:first + VISITS]
                        yield _hits(score(known, vectors, matrix(some["vector"]), k), some["query_id"].to_numpy())

    return rows.unionByName(asks).repartition(*cell).sortWithinPartitions(*cell, "_side").mapInPandas(meet, schema)


def passages(hits: DataFrame, chunks: DataFrame, length: int = 500) -> DataFrame:
    """Hits ``(id, doc, chunk, ...)`` with their text and metadata, and the start of the text as a snippet.

    A passage is named by its document, as a string, and its place there: different chunks may have the same short id.
    """
    found = chunks.select("doc_id", "chunk_index", "text", "metadata")
    same = F.col("doc").eqNullSafe(F.col("doc_id").cast("string")) & (F.col("chunk") == F.col("chunk_index"))
    return hits.join(found, same).drop("doc", "chunk").withColumn("snippet", F.substring("text", 1, length))
