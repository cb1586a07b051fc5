from __future__ import annotations

import corpus_pipeline as pipeline
import duckdb
import pytest

import __spark_entry__ as entry
from pricelode.llm.queries import ORACLES

from test_lines import brute as brute_lines
from test_minhash import brute as brute_near
from test_suffixes import brute as brute_suffixes

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(10**9)
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(spark.createDataFrame(stage(spark, out[-1], SMALL).toPandas()))
    return out


def texts(frame):
    return [(r["doc_id"], r["text"]) for r in frame.collect()]


def test_columns(steps):
    for frame in steps[1:-1]:
        assert frame.columns == list(pipeline.COLUMNS)


def test_toxicity_keeps_the_clean(spark, steps):
    labels = dict(spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "toxic").collect())
    kept = {d for d, _ in texts(steps[1])}
    clean = [d for d, t in labels.items() if t == 0]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean)


def test_lines_like_brute_force(steps):
    assert dict(texts(steps[2])) == {d: t[0] for d, t in brute_lines(texts(steps[1])).items()}


def test_near_dedup_like_brute_force(steps):
    assert {d for d, _ in texts(steps[3])} == {d for d, x in brute_near(texts(steps[2])).items() if x[2]}


def test_suffixes_like_brute_force(steps):
    want = brute_suffixes(texts(steps[3]), 100)
    got = dict(texts(steps[4]))
    assert set(got) == set(want)
    for d, t in got.items():
        assert 0 <= want[d][0] - want[d][1] - len(t.encode()) <= 6 * want[d][2]


def test_every_document_is_packed(steps):
    packed = steps[5].toPandas()
    assert set(packed["doc_id"]) == {d for d, _ in texts(steps[4])}
    assert packed.groupby("sequence_id")["length"].sum().max() <= 4096


def test_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, _stay string"
    rows = [(1, None, None, None, None, 0.1, "x"), (None, "a b c d e f", "en", "s", 11, None, None), (2, "", "en", "s", 0, None, None),
            (3, "word " * 3000, "en", "s", 15000, 1.0, "y"), (3, "word " * 3000, "en", "s", 15000, 1.0, "y")]
    for start in (rows, []):
        docs = spark.createDataFrame(start, schema)
        for _, stage in pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), stage(spark, docs, SMALL).schema)
        assert (docs.count() > 0) == bool(start)


@pytest.mark.parametrize("name", list(ORACLES))
def test_queries_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    theirs = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(map(repr, theirs.fetchall())) == sorted(
        repr(tuple(r[c] for c in columns)) for r in entry.queries()[name](spark, SMALL).collect())
