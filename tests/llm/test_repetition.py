from __future__ import annotations

import random

import numpy as np
import pytest

from pricelode.llm import repetition


def brute(text, window=8):
    data = (text or "").encode()
    w = data.split()
    n = len(w)
    longest, covered = 0, np.zeros(n, bool)
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        if best >= window:
            covered[i:i + best] = True
            longest = max(longest, best)
    lines = [x for x in data.split(b"\n") if x.split()]
    c = int(covered.sum())
    failed = n < 20 or 100 * c > 30 * n
    return (n, sum(len(x.decode()) for x in w), sum(data.count(s.encode()) for s in "#*$%&|<>"), len(lines) - len(set(lines)), c,
            longest, failed, not failed and 100 * c <= 25 * n and longest <= 50)


def found(frame):
    return {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                          r["longest_repeat"], r["base_failed"], r["kept"]) for r in repetition.rules(frame).collect()}


@pytest.mark.parametrize("words", [50, 400_000])
def test_against_all_pairs(documents, monkeypatch, words):
    monkeypatch.setattr(repetition, "WORDS", words)
    r = random.Random(2)
    rows = []
    for i in range(60):
        v = [f"é{j}#" for j in range(r.choice([2, 5, 40, 300]))]
        text = [r.choice(v) for _ in range(r.randint(0, 120))]
        at = r.randint(0, len(text))
        text += text[at:at + r.randint(0, 70)]
        rows.append((i, "".join(x + r.choice([" ", " ", "\n", "\t\n"]) for x in text)))
    rows += [(100, None), (101, ""), (102, "\n \n"), (103, "a " * 100), (104, "x\ny\nx\n\n\ny")]
    assert found(documents(rows)) == {d: brute(t) for d, t in rows}


def test_spans(documents):
    phrase = " ".join(f"p{i}" for i in range(10))
    row = repetition.rules(documents([(1, f"a {phrase} b c {phrase} d")])).first()
    assert row["spans"] == [[1, 11], [13, 23]] and row["longest_repeat"] == 10


def test_long_text_and_rows_without_id(documents):
    r = random.Random(1)
    text = " ".join(f"w{r.randint(0, 10**9)}" for _ in range(300_000))
    out = repetition.rules(documents([(None, text + " " + text[:2000]), (4, text), (4, text)])).collect()
    assert [x["kept"] for x in out if x["doc_id"] == 4] == [True, True]
    assert next(x for x in out if x["doc_id"] is None)["longest_repeat"] > 100


def test_empty_table(documents):
    assert repetition.rules(documents([])).collect() == []
