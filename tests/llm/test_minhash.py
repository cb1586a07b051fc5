from __future__ import annotations

import random

import corpus_pipeline
import pytest

from pricelode.llm import minhash
from pricelode.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def found(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame).collect()}


def copies(r, words, rate):
    out = [r.choice(["new", "other", "word"]) + str(r.randint(0, 10**6)) if r.random() < rate else w for w in words]
    return " ".join(w for w in out if r.random() > rate / 3)


@pytest.mark.parametrize(("seed", "short", "block"), [(0, 32, 1024), (1, 32, 1024), (2, 2, 1024), (3, 1, 5)])
def test_against_all_pairs(documents, seed, short, block, monkeypatch):
    monkeypatch.setattr(minhash, "SHORT", short)
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[r.choice(vocabulary) for _ in range(r.randint(6, 120))] for _ in range(12)]
    rows = [(i, copies(r, r.choice(bases), r.choice([0, 0.005, 0.02, 0.05]))) for i in range(260)]
    rows += [(1000 + i, " ".join(r.choice(vocabulary) for _ in range(50))) for i in range(30)]
    assert found(documents(rows)) == brute(rows)


def test_shared_passage_is_not_a_link(documents):
    r = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"x{r.randint(0, 10**6)}" for _ in range(r.randint(15, 60)))) for i in range(120)]
    assert found(documents(rows)) == brute(rows)


def test_odd_rows(documents):
    long = " ".join(f"w{i % 7000}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "two one"), (7, long), (8, long + " end"),
            (9, "a b c d"), (10, "a b c d e"), (11, "A b c d e"), (12, "é ü ñ ö ß"), (13, "É ü ñ ö ß")]
    assert found(documents(rows)) == brute(rows)


def test_rows_without_id_and_repeated_rows(documents):
    out = minhash.near_duplicates(documents([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f")]))
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(
        [(None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False)], key=str)


def test_empty_table(documents):
    assert minhash.near_duplicates(documents([])).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_an_id_with_different_texts_has_the_links_of_all(documents):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (7, a + " more"), (9, b + " more"), (9, None), (11, c), (12, c), (None, a), (13, ""), (9, c + " x")]
    got = sorted(tuple(r) for r in minhash.near_duplicates(documents(rows)).where("doc_id IS NOT NULL").collect())
    assert [(r[0], r[2], r[3]) for r in got] == [
        (5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (9, 5, False), (9, 5, False), (11, 5, False), (12, 5, False),
        (13, 13, True)]
    assert [tuple(r) for r in minhash.near_duplicates(documents(rows)).where("doc_id IS NULL").collect()] == [(None, 36, None, True)]


def test_stage_keeps_one_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, "", "en", "s", 0), (None, text, "en", "s", 1),
            (None, text, "en", "s", 1), (4, "other words", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()
    assert sorted((r["doc_id"] for r in got), key=str) == [1, 3, 4, None, None]
