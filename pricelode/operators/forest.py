"""Isolation forest (Liu, Ting and Zhou, 2008) on a sample of fixed size.

Every tree sees at most 256 rows, so the model does not grow with the table: rows are drawn
by the smallest hashes of their ids, trees are built in parallel, one task group each, and
the finished forest (at most trees x 511 nodes) is broadcast to score the rows in batches.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricelode.operators.statistical import column_medians, filled
from pricelode.plans.quantiles import ColumnProfile, profile

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FEATURES = [
    "wac_price", "asp_price", "amp_price", "price_340b", "gtn_price", "actual_price", "margin_percent",
]
ROWS_PER_TREE = 256
UPPER_LEVELS = 6  # so that the subtrees below them are the bits of a word


def mean_path(n: int) -> float:
    """Average depth at which a search for a missing key ends in a tree of ``n`` keys."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


@dataclass
class Forest:
    """Complete trees in heap order: ``feature`` and ``split`` per inner node, path length per bottom slot."""

    features: list[str]
    medians: dict[str, float]
    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    normaliser: float

    def scorer(self, block: int = 4_096) -> Callable[[np.ndarray], np.ndarray]:
        """A function that gives 2 ** (-mean path / c) of each row, near 1 for rows that are cut off early.

        The upper levels of a tree are not walked: a value's place among all splits of its feature up there tells which of the
        subtrees below it rules out, as a set of bits; of those that no feature rules out a row is in the leftmost.
        """
        trees = self.feature.shape[0]
        if trees == 0 or self.normaliser == 0:
            return lambda x: np.zeros(len(x))
        inner, bottom = self.feature.shape[1], self.path.shape[1]
        top = min(UPPER_LEVELS, bottom.bit_length() - 1)
        upper = 2 ** top - 1
        used = np.isfinite(self.split[:, :upper])
        places = [np.unique(self.split[:, :upper][used & (self.feature[:, :upper] == f)]) for f in range(len(self.features))]
        left = []  # per node the subtrees on its left
        for node in range(upper):
            level = (node + 1).bit_length() - 1
            wide = 1 << (top - level - 1)
            left.append(np.uint64(((1 << wide) - 1) << (2 * (node + 1 - 2 ** level) * wide)))
        masks = [np.full((trees, len(at) + 1), 2 ** 64 - 1, np.uint64) for at in places]
        for t, node in zip(*np.nonzero(used), strict=True):
            f = self.feature[t, node]
            masks[f][t, np.searchsorted(places[f], self.split[t, node]) + 1:] &= ~left[node]

        def score(x: np.ndarray) -> np.ndarray:
            total = np.zeros(len(x))
            for start in range(0, len(x), block):
                rows = x[start:start + block]
                values = np.ascontiguousarray(rows).ravel()
                first = np.arange(len(rows), dtype=np.int64) * x.shape[1]
                # How many splits a value exceeds; no value is above none.
                above = [(f, np.where(np.isnan(rows[:, f]), 0, np.searchsorted(at, rows[:, f]))) for f, at in enumerate(places) if len(at)]
                part, some = np.full(len(rows), 2 ** 64 - 1, np.uint64), np.empty(len(rows), np.uint64)
                for t in range(trees):
                    part.fill(2 ** 64 - 1)
                    for f, place in above:
                        masks[f][t].take(place, out=some, mode="clip")
                        np.bitwise_and(part, some, out=part)
                    np.negative(part, out=some)
                    np.bitwise_and(part, some, out=some)  # its lowest bit, whose number is the exponent
                    node = (some.astype(np.float64).view(np.int64) >> 52) + (upper - 1023)
                    feature, split = self.feature[t], self.split[t]
                    while len(node) and node[0] < inner:  # all rows are on the same level
                        right = values.take(first + feature.take(node)) > split.take(node)
                        node = 2 * node + 1 + right
                    total[start:start + block] += self.path[t].take(node - (bottom - 1))
            return np.exp2(-total / trees / self.normaliser)

        return score

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.scorer()(x)


def draw(df: DataFrame, n: int, trees: int, seed: int, row_id: str = "txn_id") -> DataFrame:
    """``min(256, n)`` rows per tree, chosen by hash so that the draw never changes.

    One rule for any size: rows lie on a ring at the place of their hash, trees start at even distances, and each takes the
    rows that come next. The rows that lie near enough are found without ordering the others.
    """
    per_tree = min(ROWS_PER_TREE, n)
    share = min(1.0, 4 * per_tree / max(n, 1))  # of the ring; four times what a tree is expected to need
    place = F.xxhash64(F.lit(seed), F.col(row_id)).cast("double") / F.lit(2.0 ** 64) + 0.5
    back = F.sequence(F.lit(0), F.lit(min(trees - 1, int(share * trees) + 1)))
    near = (
        df.withColumn("_place", F.least(place, F.lit(1 - 2.0 ** -53)))
        .withColumn("tree", F.explode(back)).withColumn(
            "tree", F.pmod(F.floor(F.col("_place") * trees).cast("int") - F.col("tree"), F.lit(trees)))
        .withColumn("_ahead", F.pmod(F.col("_place") - F.col("tree") / F.lit(trees), F.lit(1.0)))
        .where(F.col("_ahead") < share if share < 1 else F.lit(True)))
    order = Window.partitionBy("tree").orderBy("_ahead", row_id)
    return near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_tree).drop("_r", "_place")


def grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree: random feature, uniform cut between its extremes, until single rows or full depth."""
    inner = 2 ** depth - 1
    feature = np.zeros(inner, dtype=np.int64)
    split = np.full(inner, np.inf)  # an unused node sends everything left
    path = np.zeros(2 ** depth)
    todo = [(0, 0, np.arange(len(x)))]
    while todo:
        node, level, rows = todo.pop()
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if level == depth or len(rows) <= 1 or len(usable) == 0:
            bottom = (node + 1) * 2 ** (depth - level) - 2 ** depth
            path[bottom] = level + mean_path(len(rows))
            continue
        f = int(rng.choice(usable))
        cut = rng.uniform(lo[f], hi[f])
        if cut >= hi[f]:
            cut = lo[f]
        feature[node], split[node] = f, cut
        goes_right = x[rows, f] > cut
        todo.append((2 * node + 2, level + 1, rows[goes_right]))
        todo.append((2 * node + 1, level + 1, rows[~goes_right]))
    return feature, split, path


def fit(
    df: DataFrame, features: list[str] = FEATURES, trees: int = 200, seed: int = 42,
    known: dict[str, ColumnProfile] | None = None,
) -> Forest:
    known = known or profile(df, features)
    medians = column_medians(df, features, known)
    data = df.select("txn_id", *[filled(f, medians).alias(f) for f in features])
    n = known[features[0]].n + known[features[0]].nulls
    per_tree = min(ROWS_PER_TREE, n)
    depth = max(1, math.ceil(math.log2(max(per_tree, 2))))
    empty = np.zeros((0, 2 ** depth - 1))
    if n == 0:
        return Forest(features, medians, empty.astype(np.int64), empty, np.zeros((0, 2 ** depth)), 0.0)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        x = rows.sort_values(["_ahead", "txn_id"])[features].to_numpy(dtype=np.float64)
        feature, split, path = grow(x, depth, np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], "feature": [feature], "split": [split], "path": [path]})

    built = draw(data, n, trees, seed).groupBy("tree").applyInPandas(
        build, "tree int, feature array<long>, split array<double>, path array<double>")
    rows = sorted(built.collect(), key=lambda r: r["tree"])  # fixed size: trees x 2^depth values
    return Forest(
        features, medians,
        np.array([r["feature"] for r in rows], dtype=np.int64),
        np.array([r["split"] for r in rows]),
        np.array([r["path"] for r in rows]),
        mean_path(per_tree),
    )


def with_raw_score(df: DataFrame, model: Forest, name: str = "forest_raw") -> DataFrame:
    # Plain arrays, so that workers need nothing but numpy to read them.
    shared = df.sparkSession.sparkContext.broadcast(asdict(model))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        scorer = Forest(**shared.value).scorer()
        for columns in batches:
            yield pd.Series(scorer(np.column_stack([c.to_numpy(dtype=np.float64) for c in columns])))

    return df.withColumn(name, score(*[filled(f, model.medians) for f in model.features]))
