"""The detector ensemble: flags side by side on the row, merged without a shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode import schema
from pricelode.functions.numbers import rounded
from pricelode.operators import forest, lof, rules
from pricelode.operators.fitted import Fitted
from pricelode.operators.statistical import IQR_FEATURES, ZSCORE_FEATURES, IqrFence, ZScore
from pricelode.operators.timeseries import MOVE_KEYS, mom_flags
from pricelode.plans.durable import checkpointed, discard, freeing
from pricelode.plans.ordered import is_sampled
from pricelode.plans.quantiles import exact_quantiles, profile

SQL_METHODS = ("zscore", "iqr", "mom", "rules")
ALL_METHODS = ("zscore", "iqr", "mom", "forest", "lof", "rules")
MODEL_SCORES = {"forest": ("forest_raw", "forest_score"), "lof": ("lof_raw", "lof_score")}


def with_flags(
    df: DataFrame,
    methods: Iterable[str] = SQL_METHODS,
    z_threshold: float = 3.0,
    iqr_multiplier: float = 2.5,
    spike: float = 0.25,
    drop: float = 0.20,
    contamination: float = 0.07,
    neighbors: int = 20,
    trees: int = 200,
    seed: int = 42,
    fitted: Fitted | None = None,
) -> DataFrame:
    """All rows, with the findings of every requested detector as columns (null = not flagged).

    Detectors that ``fitted`` holds are applied as they are, whatever the other options; the rest are fitted on ``df``. A
    detector that fails fails the job; leave it out by ``methods`` instead.
    """
    fitted = fitted or Fitted()
    stored = {m for m in ("zscore", "iqr", "forest") if getattr(fitted, m) is not None}
    methods = list(methods)
    unknown = set(methods) - set(ALL_METHODS)
    if unknown:
        raise ValueError(f"unknown detectors: {', '.join(sorted(unknown))}")
    used = {"zscore": ZSCORE_FEATURES, "iqr": IQR_FEATURES, "forest": forest.FEATURES}
    wanted = [c for m in methods if m not in stored for c in used.get(m, [])]
    read = dict.fromkeys([*wanted, *(lof.FEATURES if "lof" in methods else [])])
    source, hot = df, {}
    if read:
        # The fits read their columns many times: one pass over the input writes them, and the keys that the search for hot ones samples.
        sampled = {k: F.when(is_sampled("txn_id"), F.col(k)).alias(f"_{k}") for k in MOVE_KEYS} if "mom" in methods else {}
        source = checkpointed(df.select(*read, *sampled.values()))
        hot = {"sampled": source.select(*[F.col(f"_{k}").alias(k) for k in sampled])} if sampled else {}
    known = profile(source, wanted, stored=True) if wanted else None
    z = fence = None
    if "zscore" in methods:
        z = fitted.zscore or ZScore.fit(source, threshold=z_threshold, known=known)
    if "iqr" in methods:
        fence = fitted.iqr or IqrFence.fit(source, multiplier=iqr_multiplier, known=known)
    # Before any wide step is written, as it needs most room.
    factors = lof.factors(source, neighbors=neighbors) if "lof" in methods else None
    out = mom_flags(df, spike, drop, **hot) if "mom" in methods else df.withColumns({
        "mom_type": F.lit(None).cast("string"), "mom_score": F.lit(None).cast("double"),
        "price_change": F.lit(None).cast("double"),
    })
    if read:
        discard(source)
    models = [m for m in ("forest", "lof") if m in methods]
    if "forest" in models:
        model = fitted.forest
        if model is None:
            with freeing(df.sparkSession):
                model = forest.fit(df, trees=trees, seed=seed, known=known)
        out = forest.with_raw_score(out, model, "forest_raw")
    if factors is not None:
        out = lof.join_factors(out, factors, "lof_raw")
    cuts = {"forest_raw": fitted.cut} if "forest" in stored else {}
    if any(MODEL_SCORES[m][0] not in cuts for m in models):
        # The cut-off of a model is a quantile of its own scores over all rows. What follows can be told from these columns.
        out = checkpointed(out)
    if factors is not None:
        discard(factors)
    none = F.lit(None)
    if z is not None:
        out = out.withColumns(z.columns()).withColumn("zscore_score", F.when(z.flagged(), z.score()))
    else:
        out = out.withColumns({"z_max": none.cast("double"), "z_feature": none.cast("string"),
                               "z_value": none.cast("double"), "zscore_score": none.cast("double")})
    if fence is not None:
        out = out.withColumns(fence.columns()).withColumn("iqr_score", F.when(fence.flagged(), fence.score()))
    else:
        out = out.withColumns({"iqr_distance": none.cast("double"), "iqr_feature": none.cast("string"),
                               "iqr_value": none.cast("double"), "iqr_score": none.cast("double")})
    rule_columns = rules.predicates() if "rules" in methods else {n: F.lit(False) for n in schema.REGULATORY_TYPES}
    out = out.withColumns({f"is_{n}": c for n, c in rule_columns.items()})

    raw = [MODEL_SCORES[m][0] for m in models]
    out = out.select(*[c for c in out.columns if c not in raw], *raw)
    for m in ("forest", "lof"):
        if m not in models:
            out = out.withColumns({name: none.cast("double") for name in MODEL_SCORES[m]})
    return with_top_shares(out, [MODEL_SCORES[m] for m in models], contamination, cuts)


def with_top_shares(df: DataFrame, scores: list[tuple[str, str]], share: float, known: dict[str, tuple] | None = None) -> DataFrame:
    """For each (raw, score): ``raw`` scaled to [0, 1] where it exceeds its ``1 - share`` quantile, else null.

    ``known`` has the lowest value, that quantile and the highest value of the columns that need no look at ``df``; a score
    beyond the highest is 1.
    """
    known = known or {}
    open_ = [raw for raw, _ in scores if raw not in known]
    cuts = known | (exact_quantiles(df, open_, [0.0, 1.0 - share, 1.0]) if open_ else {})
    for raw, score in scores:
        low, cut, high = cuts[raw]
        if cut is None:
            df = df.withColumn(score, F.lit(None).cast("double"))
        else:
            scaled = (F.col(raw) - F.lit(low)) / F.lit(high - low + 1e-9)
            scaled = F.least(scaled, F.lit(1.0)) if raw in known else scaled
            df = df.withColumn(score, F.when(F.col(raw) > F.lit(cut), scaled))
    return df


def _rule(name: str) -> Column:
    return F.col(f"is_{name}")


def _any_rule() -> Column:
    hit = _rule(schema.REGULATORY_TYPES[0])
    for name in schema.REGULATORY_TYPES[1:]:
        hit = hit | _rule(name)
    return hit


def _type_conditions() -> dict[str, Column]:
    """When each anomaly type applies; z-score comes before IQR, which has the same priority."""
    model = {"isolation_forest": F.col("forest_score").isNotNull(), "lof_outlier": F.col("lof_score").isNotNull()}
    moves = {t: F.col("mom_type") == t for t in ("mom_spike", "mom_drop")}
    stats = {"zscore_outlier": F.col("zscore_score").isNotNull(), "iqr_outlier": F.col("iqr_score").isNotNull()}
    return {**{n: _rule(n) for n in schema.REGULATORY_TYPES}, **model, **moves, **stats}


def _methods() -> list[tuple[Column, str]]:
    """When each method label applies, in the order the detectors run."""
    return [
        (F.col("zscore_score").isNotNull(), "Z-Score"),
        (F.col("iqr_score").isNotNull(), "IQR Fence"),
        (F.col("mom_type").isNotNull(), "MoM Change"),
        (F.col("forest_score").isNotNull(), "Isolation Forest"),
        (F.col("lof_score").isNotNull(), "LOF"),
        (_any_rule(), "Regulatory Rules"),
    ]


def _money(c: Column | str) -> Column:
    return F.format_number(c, 2)


def _descriptions() -> dict[str, Column]:
    c, s = F.col, F.format_string
    pair = [c("drug_id").cast("string"), c("pharmacy_id").cast("string")]
    return {
        "wac_breach": F.concat(F.lit("actual price $"), _money("actual_price"), F.lit(" is above WAC x 2.5 ($"),
                               _money(c("wac_price") * rules.WAC_CAP), F.lit(")")),
        "asp_wac_violation": F.concat(F.lit("ASP $"), _money("asp_price"), F.lit(" is above WAC x 1.05 ($"),
                                      _money(c("wac_price") * rules.ASP_CAP), F.lit(")")),
        "340b_ceiling_breach": F.concat(F.lit("340B price $"), _money("price_340b"),
                                        F.lit(" is above AMP x 0.855 ($"),
                                        _money(c("amp_price") * rules.CEILING_340B), F.lit(")")),
        "gtn_floor_breach": F.concat(F.lit("GTN price $"), _money("gtn_price"), F.lit(" is below WAC x 0.45 ($"),
                                     _money(c("wac_price") * rules.GTN_FLOOR), F.lit(")")),
        "margin_critical": s("margin %.1f%% is below -20%%", c("margin_percent")),
        "isolation_forest": s("isolated by the forest, score %.3f", c("forest_score")),
        "lof_outlier": s("sparse neighbourhood, factor %.3f", c("lof_raw")),
        "mom_spike": s("price rose %.1f%% (drug %s, pharmacy %s)", c("price_change") * 100, *pair),
        "mom_drop": s("price fell %.1f%% (drug %s, pharmacy %s)", -c("price_change") * 100, *pair),
        "zscore_outlier": F.concat(c("z_feature"), s(" is %.2f standard deviations off, value ", c("z_max")),
                                   _money("z_value")),
        "iqr_outlier": F.concat(c("iqr_feature"), F.lit(" is beyond its fence, value "), _money("iqr_value")),
    }


def annotate(flagged: DataFrame) -> DataFrame:
    """Merge the flags of each row: type, methods, severity, score, description and action.

    Rows without a flag stay, with a null ``anomaly_type``. A label column of the source
    that has the same name is kept as ``label_type``.
    """
    types = _type_conditions()
    labels = [F.when(hit, F.lit(label)) for hit, label in _methods()]
    found = F.col("anomaly_type")
    n = F.col("n_methods")
    if "anomaly_type" in flagged.columns:
        flagged = flagged.withColumnRenamed("anomaly_type", "label_type")
    merged = flagged.withColumns({
        "anomaly_type": F.coalesce(*[F.when(hit, F.lit(t)) for t, hit in types.items()]),
        "methods": F.array_compact(F.array(*labels)),
        # Counted and joined without the list, whose filter the JVM code generator leaves out.
        "n_methods": sum((F.when(label.isNotNull(), 1).otherwise(0) for label in labels), F.lit(0)),
        "detection_method": F.concat_ws(" | ", *labels),
        "has_rule": _any_rule(),
        "anomaly_score": F.greatest(
            "zscore_score", "iqr_score", "mom_score", "forest_score", "lof_score", F.when(_any_rule(), 1.0)),
    })
    severity = F.when(found.isNull(), None).when((n >= 3) | F.col("has_rule"), "high") \
        .when(n == 2, "medium").otherwise("low")
    merged = merged.withColumns({
        "severity": severity,
        "description": F.coalesce(*[F.when(found == t, d) for t, d in _descriptions().items()]),
    })
    action = F.when(found.isNull(), None).when(F.col("has_rule"), "regulatory_review") \
        .when(F.col("severity") == "high", "escalate") \
        .when(F.col("severity") == "medium", "investigate").otherwise("monitor")
    return merged.withColumn("recommended_action", action)


def results(annotated: DataFrame) -> DataFrame:
    """The flagged transactions only."""
    return annotated.where("anomaly_type is not null")


def severity_rank(severity: str = "severity") -> Column:
    rank = F.lit(3)
    for name, value in schema.SEVERITY_RANK.items():
        rank = F.when(F.col(severity) == name, value).otherwise(rank)
    return rank


def ranked(found: DataFrame) -> DataFrame:
    """Most severe first, then by score."""
    return found.orderBy(severity_rank(), F.desc("anomaly_score"), "txn_id")


def detect_all(df: DataFrame, methods: Iterable[str] = ALL_METHODS, **options) -> DataFrame:
    """The anomaly table: each flagged transaction once, most severe first."""
    # Rows are written on the way: what neither a detector nor the table uses is left out before.
    used = {"txn_id", *schema.RESULT_COLUMNS, *schema.PRICES, *lof.FEATURES} - {"anomaly_type", "nadac_price"}
    df = df.select(*[c for c in df.columns if c in used])
    found = ranked(results(annotate(with_flags(df, methods, **options))))
    return found.select("txn_id", *[c for c in schema.RESULT_COLUMNS if c in found.columns], "methods")


def flags_long(flagged: DataFrame, keep: list[str]) -> DataFrame:
    """One row per transaction and anomaly type that fired on it."""
    scores = {
        "isolation_forest": F.col("forest_score"), "lof_outlier": F.col("lof_score"),
        "mom_spike": F.col("mom_score"), "mom_drop": F.col("mom_score"),
        "zscore_outlier": F.col("zscore_score"), "iqr_outlier": F.col("iqr_score"),
    }
    each = [
        F.when(hit, F.struct(F.lit(t).alias("anomaly_type"), scores.get(t, F.lit(1.0)).alias("anomaly_score")))
        for t, hit in _type_conditions().items()
    ]
    return flagged.select(*keep, F.explode(F.array_compact(F.array(*each))).alias("_f")).select(*keep, "_f.*")


def summary(annotated: DataFrame) -> DataFrame:
    """One row: rows, anomalies, their rate and a map of counts by reason."""
    per_reason = annotated.groupBy("anomaly_type").agg(F.count("*").alias("n"))  # a row per type
    flagged = F.col("anomaly_type").isNotNull()
    return per_reason.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(flagged, F.col("n"))), F.lit(0)).alias("total_anomalies"),
        F.map_from_entries(F.collect_list(F.when(flagged, F.struct("anomaly_type", "n")))).alias("by_reason"),
    ).withColumn(
        "anomaly_rate_pct", rounded(F.try_divide(F.col("total_anomalies") * 100.0, F.col("total_rows")), 4))
