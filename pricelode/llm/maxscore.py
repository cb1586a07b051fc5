"""Exact top-k inner-product search by MaxScore over an inverted index of integer vector components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of one index shard and queries that meet it in one task: what bounds a task's memory, at any size of the table.
SHARD_ROWS = 16_384
QUERY_BLOCK = 2_048
#: Documents scored together; the threshold rises from one run to the next.
RUN = 4_096
#: Non-essential terms probed before the documents that can't compete any more are dropped.
PROBED = 8
_HITS = "query_id long, vec_id long, score long, copies long"


def quantised(vector: Column, scale: int = 64) -> Column:
    """``floor(scale * x)`` per component, x as double; null if the vector or a component is null or not finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))
                      & ~F.isnan(x))
    return F.when(finite, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def top_k(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 64, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``vectors`` where ``queries`` holds, the ``k`` rows of other ids of
    highest score, all if there are fewer; ties go to the smaller id.

    The components are the terms of an inverted index that is cut into shards of bounded size, dealt by a hash of id and vector.
    Blocks of queries meet every shard; within a shard each query runs MaxScore, and the shards' hits are merged by a
    grouped limit. Null ids, null vectors and vectors holding a null or a non-finite component take no part. Every row is a
    candidate, also one that repeats an id, with the same vector or another; queries that share an id have one list, of the highest
    scores of all of them. Vectors of different lengths are compared as if filled up with
    zeros. An empty table gives no rows; other columns are ignored. Counting rows runs one job when this is called.
    """
    index = (
        vectors.withColumn("_q", queries)
        .select(vectors[id_col].cast("long").alias("vec_id"), quantised(vectors[vector_col], scale).alias("v"), "_q")
        .where("vec_id IS NOT NULL AND v IS NOT NULL")
        .groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("copies"), F.least(F.count_if("_q"), F.lit(k)).alias("asked")))
    asking = F.col("asked") > 0
    found = index.agg(F.count("*"), F.count_if(asking)).first()
    shards, blocks = max(1, -(-found[0] // shard_rows)), max(1, -(-found[1] // query_block))
    shard, block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)), F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    rows = index.select("vec_id", "v", "copies", F.lit(False).alias("asks"), shard.alias("shard"), every(blocks).alias("block"))
    asks = index.where(asking).select("vec_id", "v", F.col("asked").alias("copies"), F.lit(True).alias("asks"),
                                      every(shards).alias("shard"), block.alias("block"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        return _search(pdf, k)

    hits = rows.union(asks).groupBy("shard", "block").applyInPandas(search, _HITS)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    again = hits.where("copies > 1").withColumn("copy", F.explode(F.sequence(F.lit(2), F.least("copies", F.lit(k)))))
    return hits.select("query_id", "vec_id", "score").union(again.select("query_id", "vec_id", "score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _search(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    pdf = pdf.sort_values("vec_id", kind="stable")
    asks = pdf["asks"].to_numpy(bool)
    rows, queries = pdf[~asks], pdf[asks]
    if rows.empty or queries.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "copies": []}).astype("int64")
    width = int(pdf["v"].map(len).max())
    vectors, wanted = _matrix(rows["v"], width), _matrix(queries["v"], width)
    largest = int(np.abs(vectors).max(initial=0)) * int(np.abs(wanted).max(initial=0)) * max(1, width)
    kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64  # whole numbers stay exact
    shard, copies = Shard(rows["vec_id"].to_numpy(np.int64), vectors.astype(kind)), rows["copies"].to_numpy(np.int64)
    parts = [
        (q, n, *shard.best(v, k, q))
        for q, n, v in zip(queries["vec_id"].tolist(), queries["copies"].tolist(), wanted.astype(kind), strict=True)]
    return pd.DataFrame({
        "query_id": np.concatenate([np.full(len(at), q, np.int64) for q, _, at, _ in parts]),
        "vec_id": np.concatenate([shard.ids[at] for _, _, at, _ in parts]),
        "score": np.concatenate([s for *_, s in parts]).astype(np.int64),
        "copies": np.concatenate([copies[at] * n for _, n, at, _ in parts])})


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


class Shard:
    """An inverted index of some vectors: per run of documents the postings of each term, and each term's range."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        self.runs = [(at, np.ascontiguousarray(vectors[at:at + RUN].T)) for at in range(0, len(ids), RUN)]
        self.low, self.high = vectors.min(axis=0, initial=np.inf if vectors.dtype.kind == "f" else 2**62), vectors.max(
            axis=0, initial=-np.inf if vectors.dtype.kind == "f" else -2**62)

    def best(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` best documents, best first, without those whose id is ``own``."""
        a, b = query * self.low, query * self.high
        most, spread = np.maximum(a, b), np.abs(a - b)
        order = np.argsort(-spread, kind="stable")  # the terms that can tell documents apart come first
        rest = np.concatenate([np.cumsum(most[order][::-1])[::-1], np.zeros(1, most.dtype)])  # the most that later terms add
        reach = np.concatenate([np.zeros(1, most.dtype), np.minimum(a, b)[order].cumsum()]) + rest
        places, scores = np.empty(0, np.int64), np.empty(0, query.dtype)
        for at, postings in self.runs:
            full = len(scores) >= k
            least = scores[-1] if full else None
            # Non-essential: the longest tail of terms that can't lift a document over the threshold by themselves.
            essential = min(int(np.argmax(np.append(reach <= least, True))), len(order)) if full else len(order)
            terms = order[:essential]
            score = query[terms] @ postings[terms]
            docs = None
            while full:
                keep = score + rest[essential] > least  # later documents have no smaller ids and lose a tie
                docs = np.flatnonzero(keep) if docs is None else docs[keep]
                score = score[keep]
                if essential >= len(order) or not len(docs):
                    break
                terms = order[essential:essential + PROBED]
                score = score + query[terms] @ postings[np.ix_(terms, docs)]
                essential += len(terms)
            found = at + (np.arange(postings.shape[1]) if docs is None else docs)
            other = self.ids[found] != own
            places, scores = np.concatenate([places, found[other]]), np.concatenate([scores, score[other]])
            top = np.lexsort((places, -scores))[:k]
            places, scores = places[top], scores[top]
        return places, scores
