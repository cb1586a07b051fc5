"""Fitted detectors as a stored, versioned table: fitted once, applied to new transactions without another look at the old ones.

The z-score, the IQR fence and the isolation forest are a few numbers each. A local outlier factor is not kept: it is a property
of all rows it is measured with.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.operators import forest
from pricelode.operators.statistical import IQR_FEATURES, ZSCORE_FEATURES, IqrFence, ZScore
from pricelode.plans.quantiles import exact_quantiles, profile

METHODS = ("zscore", "iqr", "forest")
_SCHEMA = "version int, detector string, item string, place int, numbers array<double>"


@dataclass
class Fitted:
    """Detectors; None for those that were not fitted. ``cut`` has the lowest forest score, the one above which a row is flagged,
    and the highest, of the rows that were fitted on."""

    zscore: ZScore | None = None
    iqr: IqrFence | None = None
    forest: forest.Forest | None = None
    cut: tuple[float | None, float | None, float | None] | None = None


def fit(df: DataFrame, methods: Iterable[str] = METHODS, z_threshold: float = 3.0, iqr_multiplier: float = 2.5, contamination: float = 0.07,
        trees: int = 200, seed: int = 42) -> Fitted:
    """Fits detectors on all rows; one profile is shared by all."""
    methods = list(methods)
    if unknown := set(methods) - set(METHODS):
        raise ValueError(f"detectors that can't be kept: {', '.join(sorted(unknown))}")
    used = {"zscore": ZSCORE_FEATURES, "iqr": IQR_FEATURES, "forest": forest.FEATURES}
    known = profile(df, [c for m in methods for c in used[m]]) if methods else None
    out = Fitted()
    if "zscore" in methods:
        out.zscore = ZScore.fit(df, threshold=z_threshold, known=known)
    if "iqr" in methods:
        out.iqr = IqrFence.fit(df, multiplier=iqr_multiplier, known=known)
    if "forest" in methods:
        out.forest = forest.fit(df, trees=trees, seed=seed, known=known)
        scored = forest.with_raw_score(df, out.forest).select("forest_raw")
        out.cut = tuple(exact_quantiles(scored, ["forest_raw"], [0.0, 1.0 - contamination, 1.0])["forest_raw"])
    return out


def rows_of(fitted: Fitted) -> list[tuple[str, str, int, list[float]]]:
    """``(detector, item, place, numbers)`` for everything that was fitted."""
    out: list[tuple[str, str, int, list[float]]] = []
    if fitted.zscore:
        out += [("zscore", "threshold", 0, [fitted.zscore.threshold])]
        out += [("zscore", f"moments {c}", i, list(m)) for i, (c, m) in enumerate(fitted.zscore.moments.items())]
        out += [("zscore", f"median {c}", i, [m]) for i, (c, m) in enumerate(fitted.zscore.medians.items())]
    if fitted.iqr:
        out += [("iqr", "multiplier", 0, [fitted.iqr.multiplier])]
        out += [("iqr", f"fence {c}", i, list(f)) for i, (c, f) in enumerate(fitted.iqr.fences.items())]
    if fitted.forest:
        model = fitted.forest
        out += [("forest", "normaliser", 0, [model.normaliser]), ("forest", "cut", 0, list(fitted.cut)),
                ("forest", "shape", 0, [*model.feature.shape, model.path.shape[1]])]
        out += [("forest", f"column {c}", i, []) for i, c in enumerate(model.features)]
        out += [("forest", f"median {c}", i, [m]) for i, (c, m) in enumerate(model.medians.items())]
        for name in ("feature", "split", "path"):
            out += [("forest", name, t, list(map(float, values))) for t, values in enumerate(getattr(model, name))]
    return out


def save(spark: SparkSession, fitted: Fitted, folder: str) -> int:
    """Stores detectors as the next version of a folder and returns its number; earlier versions stay. One writer at a time."""
    known = versions(spark, folder)
    version = known[-1] + 1 if known else 1
    rows = spark.createDataFrame(
        [(version, *r, [None if x is None else float(x) for x in numbers]) for *r, numbers in rows_of(fitted)] or [(version, "none", "", 0, [])],
        _SCHEMA)
    rows.coalesce(1).write.mode("append").partitionBy("version").parquet(folder)
    return version


def versions(spark: SparkSession, folder: str) -> list[int]:
    try:
        return sorted(r[0] for r in spark.read.schema(_SCHEMA).parquet(folder).select("version").distinct().collect())
    except AnalysisException:
        return []


def load(spark: SparkSession, folder: str, version: int | None = None) -> Fitted:
    """The given version, or the last one."""
    known = versions(spark, folder)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no fitted detectors at {folder}" + (f" of version {version}" if known else ""))
    rows = spark.read.schema(_SCHEMA).parquet(folder).where(F.col("version") == (known[-1] if version is None else version)).collect()
    rows.sort(key=lambda r: r["place"])

    def items(detector: str, prefix: str) -> dict[str, list[float]]:
        return {r["item"].removeprefix(prefix): r["numbers"] for r in rows if r["detector"] == detector and r["item"].startswith(prefix)}

    def single(values: dict[str, list[float]]) -> dict[str, float]:
        return {c: v[0] for c, v in values.items()}

    out, kept = Fitted(), {r["detector"] for r in rows}
    if "zscore" in kept:
        moments = {c: tuple(v) for c, v in items("zscore", "moments ").items()}
        out.zscore = ZScore(moments, single(items("zscore", "median ")), items("zscore", "threshold")[""][0])
    if "iqr" in kept:
        out.iqr = IqrFence({c: tuple(v) for c, v in items("iqr", "fence ").items()}, items("iqr", "multiplier")[""][0])
    if "forest" in kept:
        trees, inner, bottom = map(int, items("forest", "shape")[""])

        def table(name: str, width: int) -> np.ndarray:
            return np.array([r["numbers"] for r in rows if r["detector"] == "forest" and r["item"] == name]).reshape(trees, width)

        out.forest = forest.Forest(
            list(items("forest", "column ")), single(items("forest", "median ")), table("feature", inner).astype(np.int64),
            table("split", inner), table("path", bottom), items("forest", "normaliser")[""][0])
        out.cut = tuple(items("forest", "cut")[""])
    return out
