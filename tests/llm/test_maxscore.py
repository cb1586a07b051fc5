from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelode.llm import maxscore


def brute(rows, k, asked):
    q = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q.append((i, [math.floor(64 * x) for x in v]))
    out = []
    for i in {i for i, _ in q if asked(i)}:
        score = sorted((-sum(x * y for x, y in zip(a, b)), j) for own, a in q if own == i for j, b in q if j != i)[:k]  # noqa: B905
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(score)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, None) for i, v in rows], "vec_id long, embedding array<double>, shard int, score long").repartition(3)


@pytest.mark.parametrize("blocks", [(16_384, 2_048), (37, 3)])
def test_against_every_pair(spark, monkeypatch, blocks):
    monkeypatch.setattr(maxscore, "RUN", 16)
    r = np.random.default_rng(0)
    centres = r.normal(size=(6, 24))
    rows = [(i, (centres[r.integers(6)] + r.normal(size=24) * 0.3).tolist()) for i in range(400)]
    rows += [(i, rows[i % 7][1]) for i in range(400, 430)]
    got = maxscore.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, 20, shard_rows=blocks[0], query_block=blocks[1])
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, 20, lambda i: i % 20 == 0)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]),
            (5, []), (6, [1.0]), (7, [1.0, 2.0, 3.0]), (20, [-1.0, 1e12]), (20, [-1.0, 1e12]), (8, [1.0, 2.0])]
    got = maxscore.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, 20)
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, 20, lambda i: i % 20 == 0)


def test_empty_table(spark):
    assert maxscore.top_k(frame(spark, []), F.col("vec_id") % 20 == 0).collect() == []


def test_rows_that_share_an_id_are_all_candidates(spark, monkeypatch):
    monkeypatch.setattr(maxscore, "RUN", 8)
    r = np.random.default_rng(1)
    rows = [(int(r.integers(0, 60)), r.integers(-2, 3, 4).astype(float).tolist()) for _ in range(300)]
    rows += [(40, [1.0, 2.0, 0.0, 0.0])] * 50 + [(7, [2.0, 2.0, 2.0, 2.0])] * 30
    got = maxscore.top_k(frame(spark, rows), F.col("vec_id") % 20 == 0, 20, shard_rows=40, query_block=3)
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, 20, lambda i: i % 20 == 0)


def test_repeated_ids_as_in_the_sql(spark, tmp_path):
    import duckdb

    from pricelode.llm.queries import ORACLES, QUERIES
    rows = [(1, [1.0, 0.5], 0), (1, [2.0, 0.5], 0), (20, [1.0, 1.0], 1), (20, [0.0, 3.0], 1), (20, [0.0, 3.0], 1), (2, [1.0, 1.0], 0), (2, [1.0, 1.0], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(ORACLES["op9_topk"]).fetchall()
    got = QUERIES["op9_topk"](spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert len(want) == 12 and sorted(tuple(x) for x in got) == sorted(want)
