"""Local outlier factor (Breunig et al., 2000) by an exact, partitioned neighbour search.

Equal points are merged into one weighted location first, so repeated rows cost nothing.
A k-d tree grown on a bounded sample cuts the space into leaves of similar size, each of which is one
row of arrays. Each leaf finds neighbours among its own locations; where the neighbour ball of a location
crosses its leaf, it asks exactly the leaves the ball touches, and these send the locations that count,
each once per asking leaf. From then on only k-distances and densities of such foreign locations travel,
and all sums over neighbours are taken where the points are.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.operators.statistical import robust_scale
from pricelode.plans.durable import checkpointed, discard

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = ["actual_price", "margin_percent", "volume_units"]
LEAF_ROWS = 16_000  # locations per task group
MAX_LEAVES = 131_072  # bounds the broadcast tree (16 MB) and its sample
SAMPLES_PER_LEAF = 16
SCAN_ROWS = 256  # locations compared all with all inside a task
AXES = ["x0", "x1", "x2"]
PLACES = 2 ** 32  # a location is named by its leaf and its place there


@dataclass
class LeafTree:
    """A complete k-d tree in heap order with the box of every node, and the number of points there if that is known."""

    depth: int
    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray | None = None

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.axis[node]] >= self.cut[node])
        return node

    def touched(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs of the leaves whose box comes within ``radius`` of a point."""
        row, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            row, node = np.concatenate([row, row]), np.concatenate([2 * node + 1, 2 * node + 2])
            gap = np.maximum(np.maximum(self.low[node] - x[row], x[row] - self.high[node]), 0.0)
            near = np.sqrt((gap ** 2).sum(axis=1)) <= radius[row] * (1 + 1e-12)
            row, node = row[near], node[near]
        return row, node

    def filled(self, leaf: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray) -> LeafTree:
        """The tree with the boxes that its points fill, given number and extent of the points of each leaf that has any."""
        nodes = len(self.cut)
        counts, lows, highs = np.zeros(nodes, np.int64), np.full(self.low.shape, np.inf), np.full(self.high.shape, -np.inf)
        counts[leaf], lows[leaf], highs[leaf] = count, low, high
        for level in range(self.depth - 1, -1, -1):
            own = slice(2 ** level - 1, 2 ** (level + 1) - 1)
            left, right = slice(2 ** (level + 1) - 1, 2 ** (level + 2) - 1, 2), slice(2 ** (level + 1), 2 ** (level + 2) - 1, 2)
            counts[own] = counts[left] + counts[right]
            lows[own], highs[own] = np.minimum(lows[left], lows[right]), np.maximum(highs[left], highs[right])
        return LeafTree(self.depth, self.axis, self.cut, lows, highs, counts)

    def reach(self, x: np.ndarray, leaf: int, k: int) -> np.ndarray:
        """A radius around points of ``leaf`` that holds ``k`` other points: to the far corner of the smallest box that has them."""
        node = leaf
        while node and self.count[node] <= k:
            node = (node - 1) // 2
        if self.count[node] <= k:
            return np.full(len(x), np.inf)
        gap = np.maximum(np.abs(x - self.low[node]), np.abs(self.high[node] - x))
        return np.sqrt((gap ** 2).sum(axis=1)) * (1 + 1e-12)


def grow_tree(sample: np.ndarray, depth: int) -> LeafTree:
    """A level at a time: the points stay sorted along each axis within their node, so quartiles and medians are read off."""
    dims, nodes = sample.shape[1], 2 ** (depth + 1) - 1
    axis, cut = np.zeros(nodes, dtype=np.int64), np.zeros(nodes)
    low, high = np.full((nodes, dims), -np.inf), np.full((nodes, dims), np.inf)
    orders = [np.argsort(sample[:, d], kind="stable") for d in range(dims)]  # points by node, then along the axis
    bounds = np.array([0, len(sample)])
    for level in range(depth):
        first, n = bounds[:-1], np.diff(bounds)
        some = np.flatnonzero(n)
        own = slice(2 ** level - 1, 2 ** (level + 1) - 1)

        def at(d: int, share: float) -> np.ndarray:
            """The quantile of each node that has points."""
            place = share * (n[some] - 1)
            below = np.floor(place).astype(np.int64)
            a = sample[orders[d][first[some] + below], d]
            b = sample[orders[d][first[some] + np.minimum(below + 1, n[some] - 1)], d]
            return np.where(a == b, a, a + (b - a) * (place - below))

        if len(some):
            # Split where the middle half of the points spreads most, so far outliers do not steer.
            spread = np.column_stack([at(d, 0.75) - at(d, 0.25) for d in range(dims)])
            whole = np.column_stack([at(d, 1.0) - at(d, 0.0) for d in range(dims)])
            axis[own][some] = np.argmax(np.where(spread.max(axis=1, keepdims=True) > 0, spread, whole), axis=1)
            cut[own][some] = np.choose(axis[own][some], [at(d, 0.5) for d in range(dims)])
        a, c, node = axis[own], cut[own], np.arange(2 ** level)
        left, right = slice(2 ** (level + 1) - 1, 2 ** (level + 2) - 1, 2), slice(2 ** (level + 1), 2 ** (level + 2) - 1, 2)
        for child in (left, right):
            low[child], high[child] = low[own], high[own]
        high[left][node, a] = np.minimum(high[left][node, a], c)
        low[right][node, a] = np.maximum(low[right][node, a], c)
        of = np.repeat(node, n)  # the same for all orders
        to_right = np.zeros(len(sample), bool)
        to_right[orders[0]] = sample[orders[0], a[of]] >= c[of]
        rights = np.bincount(of, to_right[orders[0]], 2 ** level).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(np.column_stack([n - rights, rights]).ravel())])
        for d in range(dims):
            goes = to_right[orders[d]]
            rank = np.cumsum(goes) - goes  # of those that go right, how many come before
            rank -= rank[first[some]].repeat(n[some])
            place = np.where(goes, bounds[1:-1:2][of] + rank, bounds[:-1:2][of] + np.arange(len(of)) - first[of] - rank)
            moved = np.empty_like(orders[d])
            moved[place] = orders[d]
            orders[d] = moved
    return LeafTree(depth, axis, cut, low, high)


def nearest(
    queries: np.ndarray, points: np.ndarray, k: int, radius: np.ndarray | None, own: bool, block: int = 256,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, distance) of the ``k`` nearest points, by query and distance; ties go to the lower point.

    With ``own``, query i is point i and is not its own neighbour. ``radius`` drops farther points.
    """
    found = []
    for start in range(0, len(queries), block):
        q = queries[start:start + block]
        square = np.zeros((len(q), len(points)))
        for d in range(points.shape[1]):
            gap = q[:, d, None] - points[None, :, d]
            square += gap * gap
        dist = np.sqrt(square)
        if own:
            dist[np.arange(len(q)), np.arange(start, start + len(q))] = np.inf
        if dist.shape[1] > k:
            limit = np.partition(dist, k - 1, axis=1)[:, k - 1]
        else:
            limit = np.full(len(q), np.inf)
        if radius is not None:
            limit = np.minimum(limit, radius[start:start + len(q)])
        row, point = np.nonzero((dist <= limit[:, None]) & np.isfinite(dist))
        d = dist[row, point]
        order = np.lexsort((point, d, row))
        row, point, d = row[order], point[order], d[order]
        first = np.searchsorted(row, np.arange(len(q)))
        keep = np.arange(len(row)) - first[row] < k
        found.append((start + row[keep], point[keep], d[keep]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return tuple(np.concatenate(parts) for parts in zip(*found))


def nearest_in(
    queries: np.ndarray, points: np.ndarray, k: int, radius: np.ndarray | None, own: bool,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``nearest`` over many points: a small tree keeps each query to the points around it."""
    scan = max(SCAN_ROWS, 2 * k)
    if len(points) <= 4 * scan:
        return nearest(queries, points, k, radius, own)
    depth = math.ceil(math.log2(len(points) / scan))
    tree = grow_tree(points[:: max(1, len(points) // (64 * 2 ** depth))], depth)
    leaf = tree.leaf_of(points)
    order = np.argsort(leaf, kind="stable")
    bounds = np.searchsorted(leaf[order], np.arange(2 ** depth - 1, 2 ** (depth + 1)))
    members = {2 ** depth - 1 + i: order[bounds[i]:bounds[i + 1]] for i in range(2 ** depth)}
    found = []
    if own:
        radius = np.full(len(queries), np.inf)
        for rows in members.values():
            row, point, dist = nearest(points[rows], points[rows], k, None, True)
            found.append((rows[row], rows[point], dist))
            full = np.bincount(row, minlength=len(rows)) >= k
            last = np.searchsorted(row, np.arange(len(rows)), side="right") - 1
            radius[rows[full]] = dist[last[full]]
    row, node = tree.touched(queries, radius)
    if own:
        away = node != leaf[row]
        row, node = row[away], node[away]
    by_node = np.argsort(node, kind="stable")
    row, node = row[by_node], node[by_node]
    for part in np.split(np.arange(len(row)), np.flatnonzero(np.diff(node)) + 1):
        if len(part):
            asked, rows = row[part], members[node[part[0]]]
            q, point, dist = nearest(queries[asked], points[rows], k, radius[asked], False)
            found.append((asked[q], rows[point], dist))
    if not found:
        return nearest(queries[:0], points, k, None, False)
    row, point, dist = (np.concatenate(parts) for parts in zip(*found))
    best = np.lexsort((point, dist, row))
    row, point, dist = row[best], point[best], dist[best]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], point[keep], dist[keep]


def locations(df: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Distinct scaled points, and the raw values they come from, with their number of rows; these are written."""
    scaled = robust_scale(df, features)
    # + 0.0 folds -0.0 into 0.0, so that equal points group together.
    axes = [(scaled[f] + F.lit(0.0)).alias(a) for f, a in zip(features, AXES)]
    counted = checkpointed(df.groupBy(*features).agg(F.count("*").alias("raw_rows")))
    found = counted.select(*axes, *[F.col(f).alias(f"raw_{f}") for f in features], "raw_rows")
    found._step = counted._step
    return found


def sampled_tree(points: DataFrame, n: int, k: int, leaf_rows: int) -> LeafTree:
    """A tree whose leaves hold about ``leaf_rows`` of the ``n`` points, from a sample bounded by MAX_LEAVES."""
    depth = max(0, min(int(math.log2(MAX_LEAVES)), math.ceil(math.log2(max(n, 1) / max(leaf_rows, 2 * k)))))
    wanted = 2 * SAMPLES_PER_LEAF * 2 ** depth
    cut = min(2 ** 63 - 1, int(-(2 ** 63) + min(1.0, wanted / max(n, 1)) * 2 ** 64))
    hashed = points.select(*AXES, F.xxhash64(*AXES).alias("_h")).where(F.col("_h") <= cut)
    sample = hashed.limit(2 * wanted).select(*AXES).toPandas()  # the limit only guards the driver
    return grow_tree(sample.to_numpy(dtype=np.float64).reshape(-1, len(AXES)), depth)


def packed(**arrays: np.ndarray) -> dict[str, pa.Array]:
    """Arrays as one binary value each; whole numbers from 0 in the fewest bytes that hold them, of which the first byte tells."""
    def whole(x: np.ndarray) -> bytes:
        kind = np.min_scalar_type(int(x.max(initial=0)))
        return bytes([kind.itemsize]) + x.astype(kind).tobytes()

    return {name: pa.array([whole(x) if x.dtype.kind in "iu" else np.ascontiguousarray(x).tobytes()], pa.binary())
            for name, x in arrays.items()}


def unpacked(rows: pa.Table, name: str, kind: type = np.float64) -> np.ndarray:
    value = rows.column(name)[0].as_py()
    return np.frombuffer(value, np.float64) if kind is np.float64 else np.frombuffer(value, f"u{value[0]}", offset=1).astype(np.int64)


def points_in(rows: pa.Table, name: str = "x") -> np.ndarray:
    """Points that are kept an axis at a time, as equal values then stand together."""
    return unpacked(rows, name).reshape(len(AXES), -1).T


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of pairs, to the last bit those that ``nearest`` finds."""
    square = np.zeros(len(a))
    for d in range(len(AXES)):
        gap = a[:, d] - b[:, d]
        square += gap * gap
    return np.sqrt(square)


def shares(weight: np.ndarray, count: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per location how many of its ``k`` places are copies of itself; per neighbour whose it is and how many places it has.

    A neighbour takes as many places as it has rows, while there are any left.
    """
    row = np.repeat(np.arange(len(count)), count)
    own = np.minimum(weight[:len(count)] - 1, k)
    before = np.cumsum(weight[near]) - weight[near]
    before -= before[np.searchsorted(row, row)] if len(row) else 0
    return own, row, np.clip(k - own[row] - before, 0, weight[near])


def axes_of(rows: pa.Table) -> np.ndarray:
    return np.column_stack([rows.column(a).to_numpy() for a in AXES])


def by_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, values, n) if len(row) else np.zeros(n)


def leaves(points: DataFrame, n: int, k: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One written row per leaf: its locations ordered by position with their ``k`` nearest other locations, closest first.

    ``points``, a written table that is deleted on the way, has the axes and ``weight``. ``x``, ``count`` and ``kdist`` have a value per location: its place in space, how many
    neighbours it has, and the distance of the farthest that counts. ``near`` has one per neighbour: its place in the leaf, or behind
    the leaf's locations that of one of the ``foreign`` ones, whose places in space are ``far``. ``weight`` is that of the leaf's
    locations, then of the foreign ones. Distances are not kept, as places in space take far less room.
    """
    spark = points.sparkSession
    # Plain arrays, so that workers need nothing but numpy to read them.
    cuts = spark.sparkContext.broadcast(asdict(sampled_tree(points, n, k, leaf_rows)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(a).to_numpy(zero_copy_only=False) for a in AXES])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(LeafTree(**cuts.value).leaf_of(x))], [*b.schema.names, "leaf"])

    placed = checkpointed(points.select(*AXES, "weight").mapInArrow(place, "x0 double, x1 double, x2 double, weight long, leaf long"))
    discard(points)
    extent = placed.groupBy("leaf").agg(
        F.count("*").alias("n"), *(F.min(a) for a in AXES), *(F.max(a) for a in AXES)).toPandas().to_numpy(np.float64)  # a row per leaf
    tree = LeafTree(**cuts.value).filled(
        extent[:, 0].astype(np.int64), extent[:, 1].astype(np.int64), extent[:, 2:5], extent[:, 5:8])
    shared = spark.sparkContext.broadcast(asdict(tree))

    def within(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(a, "ascending") for a in AXES])
        x, leaf = axes_of(rows), rows.column("leaf")[0].as_py()
        row, near, dist = nearest_in(x, x, k, None, True)
        full = np.bincount(row, minlength=len(x)) >= k
        last = np.searchsorted(row, np.arange(len(x)), side="right") - 1
        # The k-th local distance bounds the search, or where there are too few locations a box that holds enough.
        radius = LeafTree(**shared.value).reach(x, leaf, k)
        radius[full] = dist[last[full]]
        asking, asked = LeafTree(**shared.value).touched(x, radius)
        away = asked != leaf
        asking, asked = asking[away], asked[away]
        visits = pa.StructArray.from_arrays(
            [pa.array(v) for v in (asked, x[asking, 0], x[asking, 1], x[asking, 2], radius[asking])], ["leaf", *AXES, "radius"])
        crossing = np.unique(asking)
        return pa.table({
            "leaf": pa.array([leaf]), **packed(
                x=x.T, weight=rows.column("weight").to_numpy(), count=np.bincount(row, minlength=len(x)), near=near, crossing=crossing,
                radius=radius[crossing]),
            "visits": pa.ListArray.from_arrays(pa.array([0, len(asked)], pa.int32()), visits)})

    visit = "struct<leaf: long, x0: double, x1: double, x2: double, radius: double>"
    local = checkpointed(placed.groupBy("leaf").applyInArrow(
        within, f"leaf long, x binary, weight binary, count binary, near binary, crossing binary, radius binary, visits array<{visit}>"),
        large_rows=True)
    discard(placed)
    query = local.select(F.col("leaf").alias("asks"), F.explode("visits").alias("visit")).select("asks", "visit.*")

    def answer(query: pa.Table, rows: pa.Table) -> pa.Table:
        """What counts among the asked leaf's locations, once for each leaf that asks."""
        x, weight = points_in(rows), unpacked(rows, "weight", np.int64)
        hit, point, _ = nearest_in(axes_of(query), x, k, query.column("radius").to_numpy(), False)
        wanted = np.unique(np.column_stack([query.column("asks").to_numpy()[hit], point]), axis=0).reshape(-1, 2)
        point = wanted[:, 1]
        return pa.table({"asks": wanted[:, 0], "id": rows.column("leaf")[0].as_py() * PLACES + point,
                         **{a: x[point, d] for d, a in enumerate(AXES)}, "weight": weight[point]})

    halo = query.groupBy("leaf").cogroup(local.select("leaf", "x", "weight").groupBy("leaf")).applyInArrow(
        answer, "asks long, id long, x0 double, x1 double, x2 double, weight long")

    def merge(rows: pa.Table, halo: pa.Table) -> pa.Table:
        x, weight = points_in(rows), unpacked(rows, "weight", np.int64)
        n = len(x)
        row, near = np.repeat(np.arange(n), unpacked(rows, "count", np.int64)), unpacked(rows, "near", np.int64)
        dist = between(x[row], x[near])
        foreign, others = np.zeros(0, np.int64), x[:0]
        if halo.num_rows:
            halo = halo.sort_by([(a, "ascending") for a in AXES])
            asking, others = unpacked(rows, "crossing", np.int64), axes_of(halo)
            q, point, far = nearest_in(x[asking], others, k, unpacked(rows, "radius"), False)
            place, both = np.concatenate([np.arange(n), n + np.arange(len(others))]), np.concatenate([x, others])
            row, near, dist = np.concatenate([row, asking[q]]), np.concatenate([near, place[n + point]]), np.concatenate([dist, far])
            order = np.lexsort((*both[near].T[::-1], dist, row))  # ties by position
            row, near, dist = row[order], near[order], dist[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, near, dist = row[keep], near[keep], dist[keep]
            used, back = np.unique(near[near >= n], return_inverse=True)
            foreign = halo.column("id").to_numpy()[used - n]
            weight, others = np.concatenate([weight, halo.column("weight").to_numpy()[used - n]]), others[used - n]
            near[near >= n] = n + back
        count = np.bincount(row, minlength=n)
        taken = shares(weight, count, near, k)[-1]
        kdist = np.zeros(n)
        np.maximum.at(kdist, row[taken > 0], dist[taken > 0])
        return pa.table({"leaf": rows.column("leaf"), "x": rows.column("x"), **packed(
            kdist=kdist, weight=weight, count=count, near=near, far=others.T), "foreign": pa.array([foreign], pa.list_(pa.int64()))})

    merged = checkpointed(local.drop("visits").groupBy("leaf").cogroup(halo.withColumnRenamed("asks", "leaf").groupBy("leaf")).applyInArrow(
        merge, "leaf long, x binary, kdist binary, weight binary, count binary, near binary, far binary, foreign array<long>"), large_rows=True)
    discard(local)
    return merged


def factors(
    df: DataFrame, features: list[str] = FEATURES, neighbors: int = 20, leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """The local outlier factor of every distinct combination of feature values (columns ``raw_*``), as a written table.

    Each step is deleted once the next is there, so that no more than two and what deals them out take room at a time."""
    found = locations(df, features)
    raw = [f"raw_{f}" for f in features]
    # Different raw values (null and the median) can share a location.
    points = checkpointed(found.groupBy(*AXES).agg(F.sum("raw_rows").alias("weight")))
    size = points.agg(F.count("*").alias("n"), F.coalesce(F.sum("weight"), F.lit(0)).alias("rows")).first()
    k = min(neighbors, size["rows"] - 1)
    if k < 1:
        discard(points)
        out = checkpointed(found.select(*raw, F.lit(None).cast("double").alias("factor")))
    else:
        near = leaves(points, size["n"], k, leaf_rows)
        scored = local_outlier_factor(near, k)
        discard(near)
        out = checkpointed(found.join(scored, AXES).select(*raw, "factor"))
        discard(scored)
    discard(found)
    return out


def local_outlier_factor(found: DataFrame, k: int) -> DataFrame:
    """``factor`` per location from the leaves, as a written table.

    A location of weight w counts w - 1 copies of itself at distance 0 before any other.
    """
    asked = found.select(F.col("leaf").alias("asks"), F.posexplode("foreign").alias("place", "other")).select(
        "asks", "place", F.floor(F.col("other") / PLACES).cast("long").alias("leaf"), (F.col("other") % PLACES).alias("at"))

    def fetched(values: DataFrame) -> DataFrame:
        """``leaf, place, value``: what each leaf asked of others, from one array per leaf."""
        def look(asked: pa.Table, rows: pa.Table) -> pa.Table:
            value = unpacked(rows, "value")[asked.column("at").to_numpy()]
            return pa.table({"leaf": asked.column("asks"), "place": asked.column("place"), "value": value})

        return asked.groupBy("leaf").cogroup(values.groupBy("leaf")).applyInArrow(look, "leaf long, place int, value double")

    def with_foreign(values: np.ndarray, halo: pa.Table) -> np.ndarray:
        order = np.argsort(halo.column("place").to_numpy())
        return np.concatenate([values, halo.column("value").to_numpy()[order]])

    def neighbours(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        count, near = unpacked(rows, "count", np.int64), unpacked(rows, "near", np.int64)
        own, row, taken = shares(unpacked(rows, "weight", np.int64), count, near, k)
        return own, row, near, taken

    def density(rows: pa.Table, halo: pa.Table) -> pa.Table:
        own, row, near, taken = neighbours(rows)
        x, kdist = points_in(rows), unpacked(rows, "kdist")
        dist = between(x[row], np.concatenate([x, points_in(rows, "far")])[near])
        reach = by_row(taken * np.maximum(dist, with_foreign(kdist, halo)[near]), row, len(own))
        return pa.table({"leaf": rows.column("leaf"), **packed(value=1.0 / ((own * kdist + reach) / k + 1e-10))})

    def factor(rows: pa.Table, halo: pa.Table) -> pa.Table:
        own, row, near, taken = neighbours(rows)
        lrd, x = unpacked(rows, "value"), points_in(rows)
        around = own * lrd + by_row(taken * with_foreign(lrd, halo)[near], row, len(own))
        return pa.table({**{a: x[:, d] for d, a in enumerate(AXES)}, "factor": around / k / lrd})

    lists = ["leaf", "x", "weight", "count", "near"]
    kdist = found.select("leaf", F.col("kdist").alias("value"))
    densities = checkpointed(found.select(*lists, "far", "kdist").groupBy("leaf").cogroup(fetched(kdist).groupBy("leaf")).applyInArrow(
        density, "leaf long, value binary"), large_rows=True)
    scored = checkpointed(found.select(*lists).join(densities, "leaf").groupBy("leaf").cogroup(
        fetched(densities).groupBy("leaf")).applyInArrow(factor, "x0 double, x1 double, x2 double, factor double"))
    discard(densities)
    return scored


def join_factors(
    df: DataFrame, found: DataFrame, name: str = "lof_raw", features: list[str] = FEATURES,
) -> DataFrame:
    """Give every row the factor of its feature values; a frequent value is split by the skew join."""
    renamed = found.select(*[F.col(f"raw_{f}").alias(f"_f{i}") for i, f in enumerate(features)],
                           F.col("factor").alias(name))
    match = [F.col(f).eqNullSafe(F.col(f"_f{i}")) for i, f in enumerate(features)]
    return df.join(renamed, match, "left").drop(*[f"_f{i}" for i in range(len(features))])
