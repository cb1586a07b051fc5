from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from pricelode.llm import lines


def shingles(line, size):
    w = line.encode().lower().split()
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, size=5):
    seen, out = [], {}
    for doc, text in sorted(rows):
        if text is None:
            out[doc] = (None, 0, 0)
            continue
        kept, cut = [], text.split("\n")
        for line in cut:
            s = shingles(line, size)
            if not s or not any(100 * len(s & t) >= 75 * len(s | t) for t in seen):
                kept.append(line)
            if s:
                seen.append(s)
        out[doc] = ("\n".join(kept), len(cut), len(cut) - len(kept))
    return out


def found(frame, **kw):
    return {r[0]: tuple(r)[1:] for r in lines.without_similar_lines(frame, **kw).collect()}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: f"w{min(r.randint(0, 400), r.randint(0, 400))}"
    bases = [[word() for _ in range(r.randint(1, 40))] for _ in range(25)]
    rows = []
    for i in range(90):
        cut = []
        for _ in range(r.randint(0, 6)):
            base = r.choice(bases)
            cut.append(" ".join(w if r.random() > 0.02 else word() for w in base) if r.random() < 0.7 else " ".join(
                word() for _ in range(r.randint(0, 20))))
        rows.append((i * 2, "\n".join(cut)))
    return rows


@pytest.mark.parametrize(("seed", "short", "block"), [(0, 32, 1024), (1, 2, 1024), (2, 2, 4)])
def test_against_all_pairs(documents, seed, short, block, monkeypatch):
    monkeypatch.setattr(lines, "SHORT", short)
    monkeypatch.setattr(lines, "BLOCK", block)
    rows = corpus(seed)
    assert found(documents(rows)) == brute(rows)


def test_one_id_with_different_texts(documents):
    """They are documents of their own, in the order of the MD5 of their texts."""
    same = "a b c d e f g h"
    rows = [(1, same), (2, "p q r s t u v"), (2, same), (2, same + "\nnew words in a line"), (3, "p q r s t u v"), (2, None), (None, same)]
    digest = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    own = [(i, t) for i, t in rows if i is not None]
    order = sorted({(i, digest(t)) for i, t in own})
    want = brute([(order.index((i, digest(t))), t) for i, t in own])
    got = lines.without_similar_lines(documents(rows)).collect()
    key = lambda r: (r[0], str(r[1]), *r[2:])
    assert sorted((tuple(x) for x in got if x[0] is not None), key=key) == sorted(
        ((i, *want[order.index((i, digest(t)))]) for i, t in own), key=key)
    assert [tuple(x)[1:] for x in got if x[0] is None] == [(same, 1, 0)]
    assert lines.without_similar_lines(documents(rows), carried=("bucket",)).where("carried.bucket = 'x'").count() == len(rows)


def test_single_words_as_tokens(documents):
    rows = corpus(7)
    assert found(documents(rows), size=1) == brute(rows, 1)


def test_common_line_with_variants(documents):
    r = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, "\n".join([" ".join(w if r.random() > 0.015 else f"n{r.randint(0, 999)}" for w in base), f"own line of {i} here now"]))
            for i in range(120)]
    assert found(documents(rows)) == brute(rows)


def test_odd_rows(documents):
    long = "\n".join(f"line {i} with some words in it" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "one"), (5, "ONE\n one \n\ntwo"), (6, long), (7, "line 5 with some words in it"),
            (8, "é ü\r\né ü")]
    assert found(documents(rows)) == {**brute([x for x in rows if x[0] not in (6, 7)]),
                                      6: (long, 20_000, 0), 7: ("", 1, 1)}


def test_rows_without_id_repeated_rows_and_carried_columns(documents):
    out = lines.without_similar_lines(documents([(None, "a b\na b"), (2, "a b\na b"), (2, "a b\na b")]), carried=["bucket"])
    assert sorted(((r[0], r[1], r["carried"]["bucket"]) for r in out.collect()), key=str) == sorted(
        [(None, "a b\na b", "x"), (2, "a b", "x"), (2, "a b", "x")], key=str)


def test_empty_table(documents):
    assert lines.without_similar_lines(documents([])).collect() == []


def test_parities_rule_out_pairs_that_only_share_a_token(spark, monkeypatch):
    """Lines of few words that all meet in lists: hardly any pair but the planted ones comes to the full sets."""
    rng = np.random.default_rng(4)
    rows = [[f"w{i}" for i in rng.permutation(60)[:20]] for _ in range(60)]
    rows += [[*rows[7][:-1], "other"], [*rows[30], "longer"]]
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    confirmed, met = lines._confirmed, []

    def counted(pairs, *rest):
        met.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(lines, "_confirmed", counted)
    found = lines.without_similar_lines(docs, size=1)
    assert sorted(r["doc_id"] for r in found.where("n_removed > 0").collect()) == [60, 61]
    assert 2 <= sum(met) <= 20


def test_parities_differ_in_no_more_places_than_sets(spark):
    rng = np.random.default_rng(6)
    rows = [[f"w{i}" for i in rng.permutation(300)[:n]] for n in rng.integers(1, 250, 40)]
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: (r["p1"] % 2 ** 64) << 64 | r["p2"] % 2 ** 64 for r in lines.prefixes(docs, 1, 75, 100).collect()}
    for a, x in enumerate(rows):
        assert got[a].bit_count() % 2 == len(x) % 2
        for b, y in enumerate(rows[:a]):
            assert (got[a] ^ got[b]).bit_count() <= len(set(x) ^ set(y))
