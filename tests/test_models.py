from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pricelode.operators import ensemble, forest, lof
from pricelode.operators.statistical import robust_scale
from pricelode.plans.durable import checkpointed
from pricelode.sources.tpch import pricing_fact
from registry import queries
from registry.queries import QUERIES

AXES = lof.AXES


def brute_force(x: np.ndarray, k: int) -> np.ndarray:
    """LOF by all pairs; ties at equal distance go to the lower position."""
    n = len(x)
    square = np.zeros((n, n))
    for d in range(x.shape[1]):
        gap = x[:, d, None] - x[None, :, d]
        square += gap * gap
    dist = np.sqrt(square)
    near = []
    for i in range(n):
        others = [j for j in range(n) if j != i]
        others.sort(key=lambda j: (dist[i, j], *x[j], j))
        near.append(others[:k])
    kdist = np.array([dist[i, near[i][-1]] for i in range(n)])
    lrd = np.array([1 / (np.mean([max(kdist[j], dist[i, j]) for j in near[i]]) + 1e-10) for i in range(n)])
    return np.array([np.mean(lrd[near[i]]) / lrd[i] for i in range(n)])


def clouds():
    rng = np.random.default_rng(7)
    dense, wide = rng.normal(0, 0.05, (150, 3)), rng.normal(3, 2, (100, 3))
    lattice = np.array([(a, b, c) for a in range(5) for b in range(5) for c in range(4)], dtype=float)
    copies = np.vstack([np.tile([1.0, 2.0, 3.0], (40, 1)), np.tile([1.5, 2.0, 3.0], (5, 1)), rng.normal(size=(60, 3))])
    return {"clusters": np.vstack([dense, wide, [[50.0, 50.0, 50.0]]]), "lattice": lattice, "copies": copies}


@pytest.mark.parametrize("name", ["clusters", "lattice", "copies"])
@pytest.mark.parametrize("leaf_rows", [1, 1000], ids=["leaves", "one leaf"])
def test_factors_equal_brute_force(spark, name, leaf_rows):
    x, k = clouds()[name], 6
    raw = spark.createDataFrame(
        [(i, *map(float, p)) for i, p in enumerate(x)], "i long, actual_price double, margin_percent double, volume_units double")
    scaled = robust_scale(raw, lof.FEATURES)
    points = np.array([tuple(r) for r in raw.orderBy("i").select(*scaled.values()).collect()])
    got = lof.join_factors(raw, lof.factors(raw, neighbors=k, leaf_rows=leaf_rows)).orderBy("i").collect()
    np.testing.assert_allclose([r["lof_raw"] for r in got], brute_force(points, k), rtol=1e-7)


def test_fewer_rows_than_neighbours(spark):
    raw = spark.createDataFrame([(float(i), 0.0, 1.0) for i in range(4)],
                                "actual_price double, margin_percent double, volume_units double")
    assert lof.factors(raw).count() == 4  # k falls to 3
    assert lof.factors(raw.limit(1)).first()["factor"] is None


@pytest.mark.parametrize("own", [True, False])
def test_search_inside_a_task_equals_all_pairs(own):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 0.01, (1500, 3)), rng.normal(0, 3, (1500, 3)), rng.integers(0, 5, (600, 3))])
    x = np.unique(x, axis=0)
    q = x if own else rng.normal(0, 2, (50, 3))
    radius = None if own else np.full(50, 1.5)
    got, want = lof.nearest_in(q, x, 7, radius, own), lof.nearest(q, x, 7, radius, own)
    for a, b in zip(got, want):
        np.testing.assert_array_equal(a, b)


def test_tree_routes_to_every_touched_leaf():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    tree = lof.grow_tree(x, 4)
    leaf = tree.leaf_of(x)
    radius = np.full(20, 0.7)
    row, touched = tree.touched(x[:20], radius)
    pairs = set(zip(row, touched))
    for q in range(20):
        for j in np.flatnonzero(np.linalg.norm(x - x[q], axis=1) <= 0.7):
            assert (q, leaf[j]) in pairs


@pytest.fixture(scope="module")
def prices(transactions):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(1200):
        wac = float(rng.uniform(90, 110))
        rows.append(dict(wac_price=wac, asp_price=wac * 0.95, amp_price=wac * 0.85, price_340b=wac * 0.7,
                         gtn_price=wac * 0.7, actual_price=wac * float(rng.uniform(0.85, 0.95)),
                         margin_percent=float(rng.uniform(0, 10)), volume_units=int(rng.integers(10, 50))))
    for i in (3, 400, 900):
        rows[i].update(actual_price=900.0, margin_percent=-300.0, gtn_price=5.0)
    return transactions(rows)


def test_forest_flags_the_share_and_puts_planted_rows_on_top(prices):
    scored = forest.with_raw_score(prices, forest.fit(prices)).cache()
    found = ensemble.with_top_shares(scored, [("forest_raw", "score")], 0.07).where("score is not null")
    assert abs(found.count() / 1200 - 0.07) < 0.01
    top = {r["txn_id"] for r in found.orderBy(F.desc("score")).limit(3).collect()}
    assert top == {"t00003", "t00400", "t00900"}


def test_forest_does_not_depend_on_partitioning(prices):
    scores = [
        {r[0]: r[1] for r in forest.with_raw_score(d, forest.fit(d)).select("txn_id", "forest_raw").collect()}
        for d in (prices.repartition(1), prices.repartition(7))]
    assert scores[0] == scores[1]
    other = forest.fit(prices, seed=1)
    assert not np.array_equal(other.split, forest.fit(prices).split)


def test_every_tree_gets_its_rows(prices):
    small = forest.draw(prices, 1200, 20, 42).groupBy("tree").count().collect()
    assert len(small) == 20 and {r["count"] for r in small} == {256}
    dealt = forest.draw(prices, 1200, 4, 42).groupBy("tree").count().collect()
    assert len(dealt) == 4 and {r["count"] for r in dealt} == {256}


def test_isolated_points_have_short_paths():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(255, 2)), [[40.0, 40.0]]])
    trees = [forest.grow(x, 8, np.random.default_rng(i)) for i in range(50)]
    model = forest.Forest(["a", "b"], {}, *(np.array(p) for p in zip(*trees)), forest.mean_path(256))
    s = model.score(x)
    assert s.argmax() == 255 and s[255] > 0.75 and np.median(s) < 0.5


def test_all_six_detectors_agree_on_the_planted_rows(prices):
    found = {r["txn_id"]: r for r in ensemble.detect_all(prices).collect()}
    for txn in ("t00003", "t00400", "t00900"):
        assert found[txn]["severity"] == "high"
        assert {"Z-Score", "Isolation Forest", "LOF", "Regulatory Rules"} <= set(found[txn]["methods"])


def test_transactions_against_all_pairs(spark):
    """The factor of every transaction of a table, from all its pairs."""
    fact = pricing_fact(spark, "/root/testdata/sf0.001")
    scaled = robust_scale(fact, lof.FEATURES)
    rows = fact.select("txn_id", *(c.alias(a) for a, c in zip(AXES, scaled.values()))).toPandas().sort_values([*AXES, "txn_id"])
    x, k = rows[AXES].to_numpy(), 20
    dist = np.sqrt(sum((x[:, d, None] - x[None, :, d]) ** 2 for d in range(3)))
    np.fill_diagonal(dist, np.inf)
    near = np.argsort(dist, axis=1, kind="stable")[:, :k]
    far = np.take_along_axis(dist, near, axis=1)
    lrd = 1 / (np.maximum(far, far[near, -1]).mean(axis=1) + 1e-10)
    want = dict(zip(rows["txn_id"], lrd[near].mean(axis=1) / lrd, strict=True))
    got = lof.join_factors(fact, lof.factors(fact, leaf_rows=300)).select("txn_id", "lof_raw").collect()
    assert len(got) == len(want) == 6000
    np.testing.assert_allclose([r["lof_raw"] for r in got], [want[r["txn_id"]] for r in got], rtol=1e-7)
    flagged = {r["txn_id"] for r in QUERIES["lof_transactions"](spark, "/root/testdata/sf0.001").collect()}
    top = sorted(want, key=want.get, reverse=True)
    assert flagged == set(top[:len(flagged)]) and abs(len(flagged) - 0.07 * 6000) <= 1


def test_sparse_leaves_ask_only_around_them():
    rng = np.random.default_rng(2)
    dense, lone = rng.normal(size=(2000, 3)), np.array([[40.0, 0.0, 0.0], [41.0, 0.0, 0.0]])
    x, k = np.vstack([dense, lone]), 10
    tree = lof.grow_tree(x, 5)
    above = (tree.leaf_of(lone)[0] - 1) // 2
    tree.axis[above], tree.cut[above] = 0, 20.0  # a leaf of the lone points only
    leaf = tree.leaf_of(x)
    own = np.unique(leaf)
    filled = tree.filled(own, np.array([(leaf == o).sum() for o in own]), np.array([x[leaf == o].min(axis=0) for o in own]),
                         np.array([x[leaf == o].max(axis=0) for o in own]))
    assert filled.count[0] == len(x)
    sparse = [o for o in own if (leaf == o).sum() <= k]
    assert sparse
    for o in sparse:
        q = x[leaf == o]
        radius = filled.reach(q, o, k)
        dist = np.sort(np.linalg.norm(x[None] - q[:, None], axis=2), axis=1)
        assert np.isfinite(radius).all() and (radius >= dist[:, k]).all()
        _, asked = filled.touched(q, radius)
        assert len(set(asked)) < len(own)
    few = lof.grow_tree(x[:3], 0).filled(np.array([0]), np.array([3]), x[:3].min(axis=0)[None], x[:3].max(axis=0)[None])
    assert np.isinf(few.reach(x[:3], 0, 5)).all()


def test_large_rows_are_written_and_read_a_few_at_a_time(spark):
    def filled(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.random.default_rng(i).bytes(1 << 22) for i in b.column(0).to_pylist()])], ["id", "x"])

    rows = spark.range(0, 24, 1, 1).mapInArrow(filled, "id long, x binary")
    stored = checkpointed(rows, large_rows=True)
    groups = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in stored.inputFiles()]
    assert sum(g.num_rows for g in groups) == 24
    assert max(g.row_group(i).num_rows for g in groups for i in range(g.num_row_groups)) <= 8


def test_places_among_splits_lead_where_walking_does():
    """Scores from bits of subtrees against a walk of every tree, with values on splits, missing and infinite ones."""
    rng = np.random.default_rng(3)
    for depth in (1, 4, 6, 8):
        x = np.round(rng.normal(size=(2 ** depth, 3)), 1)
        trees = [forest.grow(x, depth, np.random.default_rng(i)) for i in range(9)]
        model = forest.Forest(["a", "b", "c"], {}, *(np.array(p) for p in zip(*trees)), 2.5)
        asked = np.vstack([x, [[np.nan, 0.0, 1.0], [np.inf, -np.inf, np.nan]], np.tile(model.split.reshape(-1, 1)[:40], 3), rng.normal(size=(50, 3))])

        def end(row, t, depth=depth, model=model):
            node = 0
            for _ in range(depth):
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.split[t, node])
            return model.path[t, node - (2 ** depth - 1)]

        want = [sum(end(row, t) for t in range(9)) for row in asked]
        assert np.array_equal(model.scorer(block=7)(asked), np.exp2(-np.array(want) / 9 / 2.5))


@pytest.mark.parametrize("name", ["iforest", "lof_drugs_leaves"])
def test_transactions_are_evaluated_once(spark, prices, monkeypatch, name):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    monkeypatch.setattr(queries, "pricing_fact", lambda *_: prices.mapInArrow(counted, prices.schema))
    assert queries.QUERIES[name](spark, "").count() > 0
    assert seen.value == prices.count()


def test_trees_are_cut_at_medians_level_by_level(monkeypatch):
    """As one node at a time would, by quartiles; no call per node, of which the driver may have 131,072."""
    rng = np.random.default_rng(5)
    x = np.vstack([np.round(rng.normal(size=(700, 3)) * [1, 3, 2], 1), [[0.0, 0.0, 90.0]] * 3])
    want, parts = {}, {0: x}
    for node in range(2 ** 5 - 1):
        part = parts.pop(node)
        q1, q3 = np.quantile(part, [0.25, 0.75], axis=0)
        a = int(np.argmax(q3 - q1 if (q3 - q1).max() > 0 else np.ptp(part, axis=0)))
        want[node] = (a, np.median(part[:, a]))
        goes = part[:, a] >= want[node][1]
        parts[2 * node + 1], parts[2 * node + 2] = part[~goes], part[goes]
    monkeypatch.setattr(np, "quantile", None)
    tree = lof.grow_tree(x, 5)
    assert [(tree.axis[i], pytest.approx(tree.cut[i])) for i in want] == list(want.values())
    leaf = tree.leaf_of(x)
    assert all((x[leaf == i] >= tree.low[i]).all() and (x[leaf == i] <= tree.high[i]).all() for i in parts)


def test_the_lof_reads_transactions_once(spark, prices, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    monkeypatch.setattr(queries, "pricing_fact", lambda *_: prices.mapInArrow(counted, prices.schema))
    assert queries.QUERIES["lof_transactions"](spark, "").count() > 0
    assert seen.value == prices.count()


def test_leaves_take_little_room(spark):
    """About 24 bytes a location for its place, 8 for its k-distance and 2 for each of 20 neighbours."""
    points = spark.range(30_000).select(*[F.rand(i).alias(a) for i, a in enumerate(AXES)], F.lit(1).cast("long").alias("weight"))
    stored = lof.leaves(checkpointed(points), 30_000, 20, 4_000)
    size = sum(os.path.getsize(f.removeprefix("file:")) for f in stored.inputFiles())
    assert size < 110 * 30_000


def test_whole_numbers_take_as_many_bytes_as_they_need():
    for x in ([], [0, 255], [0, 256, 65_535], [65_536], [2 ** 32, 7]):
        values = lof.packed(x=np.array(x, np.int64))
        assert len(values["x"][0].as_py()) == 1 + len(x) * np.min_scalar_type(max(x, default=0)).itemsize
        assert lof.unpacked(pa.table(values), "x", np.int64).tolist() == x


def test_distances_are_those_of_the_search():
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(300, 3)), rng.integers(0, 3, (80, 3))])
    row, near, dist = lof.nearest_in(x, x, 9, None, True)
    assert np.array_equal(lof.between(x[row], x[near]), dist)
