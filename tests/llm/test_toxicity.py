from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricelode.llm import toxicity


def corpus(n=400):
    r = random.Random(0)
    rows, marks = [], []
    for i in range(n):
        w = [f"w{r.randint(0, 500)}" for _ in range(r.randint(5, 80))]
        bad = i % 5 == 0
        if bad:
            w[r.randint(0, len(w) - 1)] = r.choice(["nasty", "you nasty!!", "rottenly", "rottenest"])
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(bad)))
    return rows, marks


@pytest.fixture(scope="module")
def model(spark):
    rows, marks = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1, 1), (3, 1, None), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    return toxicity.fitted(docs, labels, ~toxicity.held_out(F.col("doc_id")))


def test_held_out_rows_are_told_apart(spark, documents, model):
    rows, marks = corpus()
    out = toxicity.scored(documents(rows), model).withColumn("held_out", toxicity.held_out(F.col("doc_id"))).toPandas()
    own = out[out["held_out"]].merge(spark.createDataFrame(marks, "doc_id long, q int, toxic int").toPandas(), on="doc_id")
    assert len(own) > 40 and (own["predicted"] == own["toxic"]).mean() > 0.97
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.5)).all()


def test_odd_rows(documents, model):
    rows = [(1, None), (2, ""), (3, "nasty " * 100_000), (None, "w1 w2"), (5, "w1"), (5, "w1"), (6, "\x00!!"), (7, "n.a.s.t.y")]
    out = toxicity.scored(documents(rows), model).collect()
    assert len(out) == len(rows) and {r["score"] for r in out if r["doc_id"] in (1, 2)} == {out[[r["doc_id"] for r in out].index(1)]["score"]}
    assert toxicity.scored(documents([]), model).collect() == []
    kept = toxicity.accepted(documents(rows), model)
    assert kept.columns == ["doc_id", "text", "bucket", "n_words"] and 3 not in [r["doc_id"] for r in kept.collect()]


@pytest.mark.parametrize(("marks", "score"), [([], 0.0), ([(1, 0, 1)], 1.0), ([(1, 0, 0), (2, 0, 0)], 0.0)])
def test_labels_that_are_all_alike(spark, documents, marks, score):
    docs = documents([(1, "a b"), (2, "c")])
    model = toxicity.fitted(docs.select("doc_id", "text"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), F.lit(True))
    assert [r["score"] for r in toxicity.scored(docs, model).collect()] == [score, score]


def test_isotonic_is_the_nearest_nondecreasing_fit():
    r = np.random.default_rng(0)
    score, y = r.normal(size=60).round(1), r.integers(0, 2, 60).astype(float)
    at, share = toxicity.isotonic(score, y)
    assert (np.diff(share) >= 0).all()
    fit = np.interp(score, at, share)
    for s in np.unique(score):  # the largest of the least means of the intervals around a score
        want = max(min(y[(score >= a) & (score <= b)].mean() for b in np.unique(score) if b >= s) for a in np.unique(score) if a <= s)
        assert abs(fit[score == s][0] - want) < 1e-9


def test_trees_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    trees = toxicity.Trees(x[:1500], y[:1500])
    assert ((trees.raw(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_obfuscated_and_second_person_words_count():
    lexicon = toxicity.Lexicon({b"nasty": 3.0, b"rotten*": 2.0})
    plain, near, hidden = (toxicity.features(t, lexicon) for t in (b"a nasty b rottenest c", b"you nasty", b"n4sty n.a.s.t.y"))
    assert plain[2] == 2 and plain[5] == 0 and near[5] > 0 and hidden[13] == 2 and plain[13] == 0


def test_features_of_a_long_text_take_linear_time():
    lexicon = toxicity.Lexicon({b"nasty": 3.0})
    r = random.Random(0)
    words = [r.choice(["nasty", "you", "a", "b", "c", "d", "e", "f"]) for _ in range(200_000)]
    start = time.perf_counter()
    found = toxicity.features(" ".join(words).encode(), lexicon)
    assert time.perf_counter() - start < 5
    some = words[:3_000]
    hits, people = ([i for i, w in enumerate(some) if w == x] for x in ("nasty", "you"))
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in people) for i in hits)
    assert toxicity.features(" ".join(some).encode(), lexicon)[5] == 100 * near / len(some) and 0 < found[5] < 100


def test_lexicons_leave_their_fold_out(spark, documents, monkeypatch):
    monkeypatch.setattr(toxicity, "COUNTED", 7)
    rows = [(i, f"{'nasty' if i % 2 else 'mild'} fold{i % 3} own{i % 3}x w{i}", i % 2, i % 3) for i in range(60)]
    rows += [(60, "vile one", 1, 0), (61, "vile two", 1, 0), (62, "vile six", 1, 0)]
    sample = spark.createDataFrame(rows, "doc_id long, text string, y int, fold int").repartition(4)
    whole, *folds = toxicity._lexicons(sample)
    for k, lexicon in [(-1, whole), *enumerate(folds)]:
        kept = [(set(toxicity.words_of(t.encode())), y) for _, t, y, f in rows if f != k]
        n = [sum(y == m for _, y in kept) for m in (0, 1)]
        want = {}
        for term in {x for w, _ in kept for word in w for x in toxicity.terms_of(word)}:
            hits = [sum(y == m and any(term in toxicity.terms_of(word) for word in w) for w, y in kept) for m in (0, 1)]
            odds = (hits[1] + 0.5) / (n[1] + 1) / ((hits[0] + 0.5) / (n[0] + 1))
            if hits[1] >= max(toxicity.LEAST, toxicity.SHARE * n[1]) and odds >= toxicity.ODDS:
                want[term] = np.log(odds)
        assert lexicon.terms == pytest.approx(want)
    assert b"vile" in whole.terms and b"vile" not in folds[0].terms and b"vile" in folds[1].terms


def test_one_text_of_an_id_is_learned_from(spark):
    rows, marks = corpus(200)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    again = rows + [(i, f"nasty {j}") for i in range(3) for j in range(400)]
    found = [toxicity.fitted(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels, F.lit(True))
             for r, n in [(again, 2), (again[::-1], 5)]]
    assert found[0].lexicon.terms == found[1].lexicon.terms and found[0].constant == found[1].constant == 0.2
    assert (found[0].share == found[1].share).all()
