from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from pricelode.llm import codes


def brute(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for *_, v in kept) // parts))
    kept = [(i, label, v + [0] * (parts * width - len(v))) for i, label, v in kept]
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for *_, v in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][2]))[:entries]
    books = [[cut[r][p] for r in order] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            found = {}
            for c in cut:
                found.setdefault(nearest(p, c[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(found[j]) for x in zip(*found[j], strict=True)] if j in found else e for j, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    best = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in b) for b in best]
    by_label = {}
    for (_, label, _), e in zip(kept, error, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    most = 2**63 - 1
    return [(i, "".join(f"{j:02x}" for _, j in b), min(e, most), min(by_label[label], most), sha)
            for (i, label, _), b, e in zip(kept, best, error, strict=True)]


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, label, "x", 0) for i, v, label in rows],
                                 f"vec_id long, embedding array<{kind}>, label int, code string, part int").repartition(3)


def check(spark, rows, **options):
    got = [tuple(r) for r in codes.compressed(frame(spark, rows), **options).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(brute(rows, **options), key=key)


def test_against_every_entry(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(9, 64))
    rows = []
    for i in range(300):
        v = centres[r.integers(9)] + r.normal(size=64) * 0.4
        rows.append((i * 3, (v / np.linalg.norm(v)).tolist(), [None, 1, 1, 1, 2][i % 5]))
    check(spark, rows + [(i + 1, rows[i % 4][1], 7) for i in range(0, 60, 3)])


@pytest.mark.parametrize("n", [1, 5, 70])
def test_few_rows_and_ties(spark, n):
    r = np.random.default_rng(n)
    check(spark, [(int(r.integers(40)), (r.integers(-3, 3, 32) / 256).tolist(), int(r.integers(2))) for _ in range(n)])


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 1), (4, [float("-inf"), 1.0], 1),
            (None, [1.0, 1.0], None), (None, [0.5], None), (5, [], 2), (6, [1.0], 2), (7, [0.1] * 35, 2), (20, [-1.0], 2), (20, [-1.0], 2),
            (20, [3.0], 3), (9, [-0.001] * 18, 3)]
    check(spark, rows)
    check(spark, rows, parts=3, entries=4, rounds=5)


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [1e12 * i, -1e30 * (i % 3), 3e38 * (i % 2), 0.25 * i], i % 2) for i in range(12)]
    check(spark, rows, parts=2, entries=5)


def test_empty_table(spark):
    for rows in ([], [(1, None, 1)]):
        got = codes.compressed(frame(spark, rows))
        assert got.collect() == [] and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_cells_leave_few_entries_and_are_remembered():
    r = np.random.default_rng(1)
    book, points = r.integers(-60, 60, (64, 4)), r.integers(-60, 60, (20_000, 4))
    grid, forgetful = codes.Grid(book), codes.Grid(book, remembered=3)
    index, distance = grid.nearest(points)
    every = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert grid.masks(points).mean() < 0.25 and 0 < len(grid.known) < len(points)
    assert (forgetful.nearest(points)[0] == index).all() and len(forgetful.known) == 3


def test_codes_decode_to_near_vectors(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=32).tolist(), 0) for i in range(200)]
    vectors = frame(spark, rows)
    books = codes.trained(vectors)
    coded = codes.coded(vectors, books)
    found = {x["vec_id"]: (x["vector"], x["error"]) for x in coded.join(codes.decoded(coded, books), "vec_id").collect()}
    for i, v, _ in rows:
        vector, error = found[i]
        assert round(sum((math.floor(256 * a) - 256 * b) ** 2 for a, b in zip(v, vector, strict=True))) == error
