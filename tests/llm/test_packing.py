from __future__ import annotations

import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pricelode.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def fills(lengths, bins):
    return np.bincount(bins, lengths)


def test_best_fit_is_best_fit_decreasing():
    r = np.random.default_rng(0)
    for _ in range(30):
        lengths = r.integers(1, 101, r.integers(1, 80))
        got = fills(lengths, packing.best_fit(lengths, 100))
        rooms = []
        for x in sorted(lengths, reverse=True):
            fit = min((i for i in range(len(rooms)) if rooms[i] >= x), key=lambda i: rooms[i], default=None)
            if fit is None:
                rooms.append(100 - x)
            else:
                rooms[fit] -= x
        assert sorted(got) == sorted(100 - x for x in rooms)


def test_search_empties_bins_that_best_fit_leaves():
    better = 0
    for seed in range(30):
        r, lengths = np.random.default_rng(seed), []
        for _ in range(40):  # three that fill a bin
            a = r.integers(38, 50)
            b = r.integers(20, (100 - a) // 2 + 1)
            lengths += [a, b, 100 - a - b]
        lengths = np.array(lengths)
        first = packing.best_fit(lengths, 100)
        last = packing.local_search(lengths, first, 100)
        a, b = fills(lengths, first), fills(lengths, last)
        assert b.max() <= 100 and b.sum() == a.sum() and (b**2).sum() >= (a**2).sum()
        better += (b > 0).sum() < (a > 0).sum()
    assert better > 10


def step_left(lengths, bins, capacity):
    """Whether one or two pieces of a bin can go to a bin as full or fuller, for a smaller piece or none."""
    held = {b: lengths[bins == b].tolist() for b in set(bins.tolist())}
    for a, own in held.items():
        given = {*own, *(x + y for x, y in combinations(own, 2))}
        for b, other in held.items():
            room = capacity - sum(other)
            if a != b and sum(other) >= sum(own) and any(0 < g - k <= room for g in given for k in [0, *other]):
                return True
    return False


def test_search_ends_when_no_step_is_left():
    for seed in range(8):
        r = np.random.default_rng(seed)
        lengths = r.integers(*[(25, 43), (20, 60), (1, 100), (24, 27)][seed % 4], 150)
        bins = packing.local_search(lengths, packing.best_fit(lengths, 100), 100)
        least = -(-lengths.sum() // 100)
        assert fills(lengths, bins).max() <= 100
        assert len(set(bins.tolist())) == least or not step_left(lengths, bins, 100)


def test_search_of_many_bins_goes_on():
    lengths = np.random.default_rng(0).integers(1000, 1700, 10_000)
    first = packing.best_fit(lengths, 4096)
    last = packing.local_search(lengths, first, 4096)
    assert fills(lengths, last).max() <= 4096
    assert len(set(last.tolist())) < 0.95 * len(set(first.tolist()))


def test_rounds_go_on_while_they_save_sequences(documents, monkeypatch):
    def deal(docs, *_):
        return docs.selectExpr("doc_id", "0 AS piece", "0L AS start", "cast(text AS long) AS length", "0L AS ids_crc32",
                               "0L AS task", "doc_id AS row")

    monkeypatch.setattr(packing, "pieces", deal)
    r = np.random.default_rng(3)
    rows = [(i, str(x)) for i, x in enumerate(r.integers(25, 43, 400).tolist())]
    got = packing.packed(documents(rows), "", capacity=100, lot=25).toPandas()
    assert len(got) == 400 and got.groupby("sequence_id")["length"].sum().max() <= 100
    assert (got["offset"] == 0).sum() == got["sequence_id"].nunique() < 144  # 146 if it ends after one round


@pytest.mark.parametrize("lot", [7, 40_000])
def test_every_piece_has_a_place(documents, lot):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["one", "two", "three's", "naïve"]) for _ in range(r.randint(0, 150)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "word " * 5000), (None, "no id"), (7, rows[7][1])]
    got = packing.packed(documents(rows), PATH, capacity=64, lot=lot).toPandas()
    library = Tokenizer.from_file(PATH)
    want = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(doc, k // 64, k, len(ids[k:k + 64]), zlib.crc32(np.array(ids[k:k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
    have = [(None if d != d else int(d), *map(int, x)) for d, *x in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(have, key=str) == sorted(want, key=str)
    for _, sequence in got.sort_values("offset").groupby("sequence_id"):
        assert sequence["offset"].tolist() == [0, *sequence["length"].cumsum().tolist()[:-1]] and sequence["length"].sum() <= 64
    bound = -(-got["length"].sum() // 64)
    assert got["sequence_id"].nunique() <= bound + (1 if lot == 40_000 else 4)


def test_pieces_that_leave_room_everywhere(documents):
    got = packing.packed(documents([(i, "a " * 39) for i in range(60)]), PATH, capacity=64, lot=10).toPandas()
    assert got["sequence_id"].nunique() == 60 and (got["offset"] == 0).all()


def test_empty_table(documents):
    assert packing.packed(documents([]), PATH).collect() == []
