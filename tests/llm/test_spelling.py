from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations
from zlib import crc32

import pytest

from pricelode.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts):
    near = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    rows = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(rows, key=str)


def counted(docs, slips):
    seen = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if slips and h % slips == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 3}


def words(n, alphabet, lengths, seed=0):
    r = random.Random(seed)
    return {"".join(r.choice(alphabet) for _ in range(r.choice(lengths))): r.choice([1, 2, 4, 9, 30, 70]) for _ in range(n)}


@pytest.mark.parametrize(("alphabet", "lengths"), [("ab", range(1, 9)), ("abcé", (5, 6, 7)), ("aÿ", (7, 8, 9))])
@pytest.mark.parametrize("group", [4_096, 3])
def test_every_pair_of_words(spark, alphabet, lengths, group):
    counts = words(150, alphabet, lengths)
    frame = spark.createDataFrame([(w, n, "x") for w, n in counts.items() if len(w) > 1], "word string, n long, half string")
    got = [tuple(r) for r in spelling.grouped(frame, group=group).collect()]
    assert sorted(got, key=str) == brute({w: n for w, n in counts.items() if len(w) > 1})
    pairs = [(r["word"], r["near"]) for r in spelling.near_pairs(frame, group=group).collect()]
    assert len(pairs) == len(set(pairs))


@pytest.mark.parametrize("slips", [None, 3])
def test_texts_to_variants(spark, documents, slips):
    r = random.Random(1)
    base = ["colour", "color", "colours", "theatre", "theater", "ÉCOLE", "École", "ab×cde", "Straße", "short", "shirt", "İstanbul", "naïve1naive"]
    rows = [(i, " ".join(r.choice(base) + r.choice(["", ".", "-", "\n", "s"]) for _ in range(40))) for i in range(30)]
    rows += [(None, "colour color"), (1, None), (2, ""), (7, "colour"), (7, "colour"), (8, "x" * 70_000 + " " + "x" * 69_999)]
    rows += [(i, "y" * 50_000 + "zz" + " " + "y" * 50_000 + "z") for i in (50, 51, 52)]
    got = [tuple(x) for x in spelling.variants(documents(rows), slips=slips).collect()]
    assert sorted(got, key=str) == brute(counted(rows, slips))


def test_empty_table(documents):
    for rows in ([], [(1, None), (2, "a b c")]):
        got = spelling.variants(documents(rows))
        assert got.collect() == [] and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_long_chains_reach_their_root(spark):
    chain = [("a" * i + "b" * (12 - i), 3 * 2**i) for i in range(13)]
    got = {r["word"]: r["root"] for r in spelling.grouped(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert set(got.values()) == {"a" * 12}


def test_acceptor_is_minimal_and_accepts_its_words():
    own = sorted(words(300, "abc", range(1, 7), 3))
    machine = spelling.Acceptor(own)
    accepted, open_ = [], [(machine.start, "")]
    while open_:
        q, before = open_.pop()
        accepted += [before] if machine.final[q] else []
        open_ += [(s, before + c) for c, s in machine.arcs[q].items()]
    assert sorted(accepted) == own
    rest = {q: frozenset(machine.both(q, q)) for q in range(len(machine.arcs))}
    assert len(set(rest.values())) == len(rest)
    assert sorted(tuple(sorted(p)) for p in machine.pairs()) == sorted(p for p in combinations(own, 2) if one_edit(*p))
