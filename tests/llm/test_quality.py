from __future__ import annotations

import random
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricelode.llm import quality, toxicity


def corpus(n=400):
    r = random.Random(0)
    rows, marks = [], []
    for i in range(n):
        w = [f"w{r.randint(0, 300)}" for _ in range(r.randint(20, 80))]
        bad = i % 4 == 0
        if bad:
            w = [x + "$$$" for x in w] if i % 8 else w[:4] * 12
        rows.append((i, " ".join(w)))
        marks.append((i, int(not bad), 0))
    return rows, marks


@pytest.fixture(scope="module")
def machine(spark):
    rows, marks = corpus()
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in [*rows, (8, "a"), (8, None)]], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([*marks, (None, 1, 1), (3, None, 1), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    return quality.fitted(docs, labels, ~toxicity.held_out(F.col("doc_id")), ("n_chars",))


def test_held_out_rows_are_told_apart(spark, documents, machine):
    rows, marks = corpus()
    docs = documents(rows).withColumn("n_chars", F.length("text"))
    out = quality.scored(docs, machine, ("n_chars",)).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).toPandas()
    own = out[out["held_out"]].merge(spark.createDataFrame(marks, "doc_id long, y int, t int").toPandas(), on="doc_id")
    assert len(own) > 40 and (own["predicted"] == own["y"]).mean() > 0.97
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.3)).all()


def test_odd_rows(documents, machine):
    rows = [(1, None), (2, ""), (3, "w1 $$$\n" * 200_000), (None, "w1 w2"), (5, "w1"), (5, "w1"), (6, "\x00!!"), (7, "é" * 100_000)]
    docs = documents(rows).withColumn("n_chars", F.when(F.col("doc_id") != 5, F.lit(float("nan"))))
    start = time.perf_counter()
    out = quality.scored(docs, machine, ("n_chars",)).collect()
    assert time.perf_counter() - start < 20
    assert len(out) == len(rows) and len({r["score"] for r in out if r["doc_id"] in (1, 2)}) == 1
    assert all(0 <= r["score"] <= 1 for r in out)
    assert quality.scored(documents([]).withColumn("n_chars", F.lit(1)), machine, ("n_chars",)).collect() == []


@pytest.mark.parametrize(("marks", "score"), [([], 0.0), ([(1, 1, 0)], 1.0), ([(1, 0, 0), (2, 0, 0)], 0.0)])
def test_labels_that_are_all_alike(spark, documents, marks, score):
    docs = documents([(1, "a b"), (2, "c")])
    machine = quality.fitted(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), F.lit(True))
    assert [r["score"] for r in quality.scored(docs, machine).collect()] == [score, score]


def test_score_is_the_sum_over_all_pairs():
    r = np.random.default_rng(0)
    weight, factors = r.normal(size=50), r.normal(size=(50, 5))
    rows = [r.choice(50, n, replace=False) for n in (0, 1, 2, 7, 20)]
    values = [r.normal(size=len(f)) for f in rows]
    owner = np.repeat(np.arange(5), [len(f) for f in rows])
    got, _ = quality.squares(owner, 5, np.concatenate(rows), np.concatenate(values), 0.3, weight, factors)
    for f, x, score in zip(rows, values, got, strict=True):
        pairs = sum(factors[f[i]] @ factors[f[j]] * x[i] * x[j] for i, j in combinations(range(len(f)), 2))
        assert abs(score - (0.3 + weight[f] @ x + pairs)) < 1e-9


def test_learns_an_interaction():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2, 3000), r.integers(0, 2, 3000)
    y = (a ^ b).astype(float)
    owner, bucket = np.repeat(np.arange(3000), 2), np.stack([a, 2 + b], axis=1).ravel()
    own = quality.Machine(y, owner, bucket, np.ones(6000), np.zeros((3000, 0)), np.zeros((3000, 0), np.int64))
    score, _ = quality.squares(owner, 3000, bucket, np.ones(6000), own.bias, own.weight, own.factors)
    assert ((score > 0) == y).mean() > 0.99


def test_statistics_against_plain_counts():
    texts = ["Ab c!\nab  DÉ a1$", "", None, "x y z x y z x y z", "#" * 50, "one\n\ntwo three\n"]
    found = [(owner, bucket, value, s) for owner, bucket, value, s in quality.features(pa.array(texts))]
    assert len(found) == 1
    owner, _, value, statistics = found[0]
    for i, text in enumerate(texts):
        text = text or ""
        data, words = text.encode(), text.encode().lower().split()
        n, size = max(1, len(words)), max(1, len(data))
        runs = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
        letters = max(1, sum(c.isascii() and c.isalpha() for c in text))
        want = [np.log1p(len(words)), size / n, sum("A" <= c <= "Z" for c in text) / letters, sum(c in "0123456789" for c in text) / size,
                sum(c in "#*$%&|<>~^_=+@\\/{}[]" for c in text) / size, sum(c in ".,;:?'\"()-" for c in text) / size,
                text.count("!") / size, sum(b > 127 for b in data) / size, np.log1p(text.count("\n")), n / (text.count("\n") + 1),
                len(set(words)) / n, 1 - len(set(runs)) / max(1, len(runs)) if runs else 1.0, max(map(words.count, words), default=0) / n]
        assert np.allclose(statistics[i], want), (text, statistics[i], want)
        assert abs((value[owner == i] ** 2).sum() - bool(words)) < 1e-9
