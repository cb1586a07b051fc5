from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from pricelode.llm import suffixes


def brute(rows, length):
    """What remains of each document, string by string."""
    earliest, out = set(), {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            piece = data[i:i + length]
            if piece in earliest:
                gone[i:i + length] = True
            earliest.add(piece)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out[doc] = (len(data), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def found(docs, **kw):
    return {r[0]: tuple(r)[1:] for r in suffixes.digest(suffixes.without_repeats(docs, **kw)).collect()}


def corpus(seed, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    passages = [" ".join(word() for _ in range(r.randint(5, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 30)))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            parts += [p[a:a + r.randint(20, 300)], word()]
        rows.append((i * 3, " ".join(parts)))
    rows += [(500, rows[1][1]), (501, rows[1][1]), (502, "ab" * 400), (503, "ab" * 300), (504, "a" * 100), (505, "a" * 99)]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_every_string(documents, seed, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET", 300)
    rows = corpus(seed)
    assert found(documents(rows), length=30, gram=12) == brute(rows, 30)


def test_one_id_with_different_texts(spark, documents):
    """They are documents of their own, in the order of the MD5 of their texts."""
    r = random.Random(4)
    p, q = ("".join(r.choice("abcdefg ") for _ in range(150)) for _ in range(2))
    rows = [(1, p + " first"), (2, "7 bytes" + q), (2, "zzzz " + p), (2, "zzzz " + p), (2**62, q), (2, None), (-5, "x" + p[:120]), (None, p)]
    order = sorted({(i, hashlib.md5((t or "").encode()).hexdigest()) for i, t in rows if i is not None})
    want = brute({(order.index((i, hashlib.md5((t or "").encode()).hexdigest())), t) for i, t in rows if i is not None}, 100)
    got = suffixes.digest(suffixes.without_repeats(documents(rows))).collect()
    assert sorted(tuple(x) for x in got if x[0] is not None) == sorted(
        (i, *want[order.index((i, hashlib.md5((t or "").encode()).hexdigest()))]) for i, t in rows if i is not None)
    assert [x["n_removed"] for x in got if x[0] is None] == [0]
    assert suffixes.without_repeats(documents(rows), carried=("bucket",)).where("carried.bucket = 'x'").count() == len(rows)


def test_one_bucket_and_the_default_length(documents):
    rows = corpus(9)
    assert found(documents(rows)) == brute(rows, 100)


def test_hot_passage_over_many_buckets(documents, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET", 50)
    monkeypatch.setattr(suffixes, "SAMPLED", 16)
    rows = [(i, f"{i:09d}" * 3 + "the same passage in every document, long enough to count" + f"{i * 7:09d}" * 2) for i in range(200)]
    assert found(documents(rows), length=40, gram=20) == brute(rows, 40)


def test_odd_rows(documents):
    long = "word " * 200_000
    rows = [(1, None), (2, ""), (3, "x" * 99), (4, long), (5, "no repeat here"), (None, "y" * 300), (None, None)]
    out = suffixes.digest(suffixes.without_repeats(documents(rows)))
    got = {r[0]: tuple(r)[1:] for r in out.where("doc_id IS NOT NULL").collect()}
    assert got == brute(rows, 100)
    assert sorted(r["n_removed"] for r in out.where("doc_id IS NULL").collect()) == [0, 0]


def test_repeated_rows_are_one_document(documents):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(7, text), (7, text), (9, text)]
    assert sorted(tuple(r)[:3] for r in suffixes.digest(suffixes.without_repeats(documents(rows))).collect()) == [
        (7, len(text), 0), (7, len(text), 0), (9, len(text), len(text))]


def test_empty_table(documents):
    assert suffixes.without_repeats(documents([])).collect() == []


def test_orders_by_token_after_token():
    r = np.random.default_rng(0)
    keys = [r.integers(0, 4, 500).astype(np.uint64) for _ in range(4)]
    assert (suffixes.multikey_order(*keys) == np.lexsort(keys[::-1])).all()


def test_deals_like_a_comparison():
    r = np.random.default_rng(1)
    keys = tuple(r.integers(0, 3, 300) for _ in range(3))
    splits = sorted({tuple(int(x) for x in r.integers(0, 3, 3)) for _ in range(8)})
    got = suffixes.dealt(tuple(np.array(c) for c in zip(*splits)), keys)
    assert got.tolist() == [sum(s <= k for s in splits) for k in zip(*(k.tolist() for k in keys))]
