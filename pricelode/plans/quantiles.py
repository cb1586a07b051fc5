"""Exact quantiles with bounded memory.

``percentile`` keeps one map entry per distinct value, which a price column of a large table does not allow. Here the rows
that can hold a wanted rank are narrowed by **rank**: approximate quantiles are the cuts, one scan counts exactly what lies
below the cuts around a rank and writes the values between them with their numbers. Further cuts are taken from what is left
there, so each pass leaves about one in ``CUTS`` values, for any distribution, infinities and heavy repeats included; when few
enough are left they are sorted and the rank is read off.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricelode.plans.durable import checkpointed, discard

CUTS = 64
FINAL_ROWS = 20_000
#: Relative rank error of the cuts is one over this; it only decides how even the parts are.
ACCURACY = 1_000
#: The first cuts are taken from one row in so many, which likewise only decides how even the parts are.
CUT_ROWS = 16


@dataclass
class _Span:
    """Values of one column between lo and hi (None: without end), ``rows`` different ones; ``below`` rows sort before it. ``k`` is
    its number in the table of held values."""

    col: int
    lo: float | None
    hi: float | None
    below: int
    rows: int
    ranks: list[int]
    k: int = 0

    @property
    def settled(self) -> bool:
        return self.lo == self.hi


@dataclass
class ColumnProfile:
    """What one pass tells about a numeric column."""

    n: int
    nulls: int
    low: float | None
    high: float | None
    mean: float | None
    std: float | None
    cuts: list[float] = field(default_factory=list)


def _cuts(value: Column, number: int) -> Column:
    """Approximate quantiles that cut the values into parts of about the same size."""
    shares = F.array(*[F.lit(k / (number + 1)) for k in range(1, number + 1)])
    return F.percentile_approx(value, shares, F.lit(max(ACCURACY, 4 * number)))


def _part(value: Column, cuts: Column) -> Column:
    """Even where the value lies between cuts, odd where it is one; equal cuts count once."""
    return F.size(F.filter(cuts, lambda c: c < value)) * 2 + F.array_contains(cuts, value).cast("int")


def profile(df: DataFrame, cols: list[str], cuts: int = CUTS, stored: bool = False) -> dict[str, ColumnProfile]:
    """Counts, moments and first cuts of numeric columns, from one scan; from two where ``df`` is a written table, as the cuts keep
    the other figures from being added up by generated code."""
    names = list(dict.fromkeys(cols))
    picked = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(CUT_ROWS)) == 0
    data = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)], picked.alias("picked"))

    def each(**aggs) -> list[Column]:
        return [agg(F.col(f"v{i}")).alias(f"{name}{i}") for i in range(len(names)) for name, agg in aggs.items()]

    moments = [F.count("*").alias("rows"), *each(n=F.count, lo=F.min, hi=F.max, mean=F.avg, std=F.stddev_samp)]
    if stored:
        row = data.agg(*moments).first().asDict() | data.where("picked").agg(*each(cuts=lambda v: _cuts(v, cuts))).first().asDict()
    else:
        row = data.agg(*moments, *each(cuts=lambda v: _cuts(F.when(F.col("picked"), v), cuts))).first()
    return {
        c: ColumnProfile(row[f"n{i}"], row["rows"] - row[f"n{i}"], *(row[f"{k}{i}"] for k in ("lo", "hi", "mean", "std")),
                         row[f"cuts{i}"] or [])
        for i, c in enumerate(names)
    }


def exact_quantiles(
    df: DataFrame, cols: list[str], probs: list[float], known: dict[str, ColumnProfile] | None = None,
    bins: int = CUTS, final_rows: int = FINAL_ROWS,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of each column, nulls skipped.

    The input is read once behind its profile: the values between the cuts around each wanted rank are written with their
    numbers, and all further passes read those.
    """
    known = known or profile(df, cols, bins)
    data = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    found: dict[tuple[int, int], float] = {}
    spans = [
        _Span(i, *_around(known[c], p), 0, known[c].n, sorted(set(_ranks(p, known[c].n))))
        for i, c in enumerate(cols) if known[c].n for p in dict.fromkeys(probs)
    ]
    ends = {(s.col, r): end for s in spans for r, end in (
        (0, known[cols[s.col]].low), (known[cols[s.col]].n - 1, known[cols[s.col]].high))}
    spans = [t for s in spans if (t := replace(s, ranks=[r for r in s.ranks if (s.col, r) not in ends])).ranks]
    found.update(ends)
    steps, spans = _hold(data, spans) if spans else ([], [])
    if steps:
        held = reduce(DataFrame.union, [step.where("side = 0").select("k", "v", "n") for step in steps])
    while spans:
        for s in [s for s in spans if s.settled]:
            found.update({(s.col, r): s.lo for r in s.ranks})
        spans = [s for s in spans if not s.settled]
        small = [s for s in spans if s.rows <= final_rows]
        wide = [s for s in spans if s.rows > final_rows]
        if small:
            found.update(_read_ranks(held, small))
        spans = _narrow(held, wide, bins) if wide else []
    discard(*steps)
    return {
        c: [_interpolate(p, known[c].n, lambda r, i=i: found[i, r]) if known[c].n else None for p in probs]
        for i, c in enumerate(cols)
    }


def _on(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """An equi-join in which nulls meet."""
    b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    return a.join(b, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])).drop(*[f"_{k}" for k in keys])


def quantile_table(
    df: DataFrame, by: str, cols: list[str], probs: list[float], bins: int = CUTS, final_rows: int = FINAL_ROWS,
) -> DataFrame:
    """``(by, column, quantiles)``: quantiles per value of ``by`` and column, for any number of groups.

    The parts still open are a table that joins the values on the group; groups of at most ``final_rows`` values are
    sorted at once. Quantiles are null where a group has no value. Jobs run and steps are written when this is called.
    """
    spread = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])
    values = checkpointed(df.select(F.col(by).alias("g"), F.explode(spread).alias("s")).select("g", "s.*"))  # every pass reads it
    key = ["g", "column"]
    span = [*key, "below"]
    sizes = checkpointed(values.groupBy(*key).agg(F.count("x").alias("n")))
    low = lambda p: F.floor(F.lit(p) * (F.col("n") - 1))
    wanted = F.array_sort(F.array_distinct(F.flatten(F.array(*[
        F.array(low(p), F.least(low(p) + 1, F.col("n") - 1)) for p in probs]))))
    spans = sizes.where("n > 0").select(
        *key, F.lit(0).cast("long").alias("below"), "n", F.lit(-math.inf).alias("lo"), F.lit(math.inf).alias("hi"),
        wanted.alias("ranks"))
    found = []
    while True:
        spans = checkpointed(spans)
        if spans.isEmpty():
            break
        held = _on(values.where("x IS NOT NULL"), spans, key).where("x >= lo AND x <= hi")
        few = held.where(F.col("n") <= final_rows).groupBy(*span).agg(
            F.array_sort(F.collect_list("x")).alias("all"), F.first("ranks").alias("ranks"))
        found.append(few.select(*key, "below", "all", F.explode("ranks").alias("rank")).select(
            *key, "rank", F.element_at("all", (F.col("rank") - F.col("below") + 1).cast("int")).alias("value")))
        wide = held.where(F.col("n") > final_rows)
        cuts = checkpointed(wide.groupBy(*span).agg(_cuts(F.col("x"), bins).alias("cuts"), F.first("ranks").alias("ranks")))
        parts = (
            _on(wide.drop("ranks"), cuts.drop("ranks"), span).withColumn("part", _part(F.col("x"), F.col("cuts")))
            .groupBy(*span, "part").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))
        before = W.partitionBy(*span).orderBy("part")  # at most 2 * bins + 1 rows
        start = (F.col("below") + F.sum("n").over(before) - F.col("n")).alias("start")
        parts = _on(parts.select("*", start), cuts.select(*span, "ranks"), span).withColumn(
            "ranks", F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n"))))
        parts = checkpointed(parts.where(F.size("ranks") > 0).select(
            *key, F.col("start").alias("below"), "n", "lo", "hi", "ranks"))
        found.append(parts.where("lo = hi").select(*key, F.explode("ranks").alias("rank"), F.col("lo").alias("value")))
        spans = parts.where("lo <> hi")
    picked = reduce(DataFrame.union, found) if found else sizes.select(*key, F.col("n").alias("rank"), F.lit(0.0).alias("value")).limit(0)
    picked = picked.groupBy(*key).agg(F.map_from_entries(F.collect_set(F.struct("rank", "value"))).alias("at"))
    joined = sizes.withColumnsRenamed({k: f"_{k}" for k in key}).join(
        picked, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]), "left")
    a = lambda p: F.element_at("at", low(p))
    b = lambda p: F.element_at("at", F.least(low(p) + 1, F.col("n") - 1))
    exact = [F.when(a(p) == b(p), a(p)).otherwise(a(p) + (b(p) - a(p)) * (F.lit(p) * (F.col("n") - 1) - low(p))) for p in probs]
    return joined.select(F.col("_g").alias(by), F.col("_column").alias("column"),
                         F.when(F.col("n") > 0, F.array(*exact)).alias("quantiles"))


def grouped_quantiles(
    df: DataFrame, by: str, cols: list[str], probs: list[float], **options,
) -> dict[object, dict[str, list[float | None]]]:
    """``quantile_table`` on the driver, for a column of few distinct values."""
    out: dict[object, dict[str, list[float | None]]] = {}
    for r in quantile_table(df, by, cols, probs, **options).collect():
        out.setdefault(r[by], {})[r["column"]] = r["quantiles"] or [None] * len(probs)
    return out


def _around(known: ColumnProfile, p: float) -> tuple[float | None, float | None]:
    """The cuts below and above the share ``p``, farther from it than they may be off; None where there is none."""
    off, parts = 2 / ACCURACY + 1 / known.n + 2 * math.sqrt(CUT_ROWS / known.n), len(known.cuts) + 1  # four standard errors
    below = [c for k, c in enumerate(known.cuts, 1) if k / parts < p - off]
    above = [c for k, c in enumerate(known.cuts, 1) if k / parts > p + off]
    return below[-1] if below else None, above[0] if above else None


def _ranks(p: float, n: int) -> tuple[int, int]:
    low = math.floor(p * (n - 1))
    return low, min(low + 1, n - 1)


def _interpolate(p: float, n: int, value) -> float:
    low, high = _ranks(p, n)
    frac = p * (n - 1) - low
    a, b = value(low), value(high)
    return a if frac == 0 or a == b else a + (b - a) * frac


def _hold(data: DataFrame, spans: list[_Span]) -> tuple[list[DataFrame], list[_Span]]:
    """One pass over the input: the values between the bounds of each span as a written table ``(k, side, v, n)``, where they have
    side 0, and the spans with what lies below them. Where a bound was off, the values on its other side follow in a pass of their own."""
    tables, out, open_, k = [], [], spans, 0
    while open_:
        hits = []
        for i, s in enumerate(open_, k):
            v = F.col(f"v{s.col}")
            low = F.lit(False) if s.lo is None else v < F.lit(s.lo)
            high = F.lit(False) if s.hi is None else v > F.lit(s.hi)
            part = F.struct(F.lit(i).alias("k"), F.when(low, -1).otherwise(0).alias("side"), F.when(~low, v).alias("v"))
            hits.append(F.when(v.isNotNull() & ~high, part))
        held = checkpointed(
            data.select(F.explode(F.array(*hits)).alias("h")).where("h is not null").groupBy("h.k", "h.side", "h.v").agg(
                F.count("*").alias("n")))
        counted = {(r["k"], r["side"]): r for r in held.groupBy("k", "side").agg(
            F.sum("n").alias("n"), F.count("*").alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
        again = []
        for i, s in enumerate(open_, k):
            below, inside = counted.get((i, -1)), counted.get((i, 0))
            first = below["n"] if below else 0
            behind = first + (inside["n"] if inside else 0)
            ranks = [r for r in s.ranks if first <= r < behind]
            if ranks:
                out.append(_Span(s.col, inside["lo"], inside["hi"], first, inside["rows"], ranks, k=i))
            if rest := [r for r in s.ranks if r < first]:
                again.append(replace(s, lo=None, ranks=rest))
            if rest := [r for r in s.ranks if r >= behind]:
                again.append(replace(s, hi=None, ranks=rest))
        tables.append(held)
        open_, k = again, k + len(open_)
    return tables, out


def _in_spans(held: DataFrame, spans: list[_Span]) -> DataFrame:
    """The rows of ``held`` within the spans, with the number ``s`` of their span."""
    number = F.coalesce(*[F.when((F.col("k") == s.k) & F.col("v").between(F.lit(s.lo), F.lit(s.hi)), F.lit(i)) for i, s in enumerate(spans)])
    return held.withColumn("s", number).where("s IS NOT NULL")


def _narrow(held: DataFrame, spans: list[_Span], bins: int) -> list[_Span]:
    """Replace each span by the parts between its cuts that hold its ranks."""
    rows = _in_spans(held, spans)
    cuts = {r["s"]: sorted(set(r["cuts"])) for r in rows.groupBy("s").agg(_cuts(F.col("v"), bins).alias("cuts")).collect()}
    own = F.coalesce(*[F.when(F.col("s") == i, F.array(*[F.lit(c) for c in cuts[i]])) for i in cuts])
    counted = rows.groupBy("s", _part(F.col("v"), own).alias("b")).agg(
        F.sum("n").alias("n"), F.count("*").alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    by_span: dict[int, list] = {}
    for row in counted.collect():  # at most 2 * bins + 1 rows per span
        by_span.setdefault(row["s"], []).append(row)

    out = []
    for i, s in enumerate(spans):
        below = s.below
        for row in sorted(by_span[i], key=lambda r: r["b"]):
            ranks = [r for r in s.ranks if below <= r < below + row["n"]]
            if ranks:
                out.append(_Span(s.col, row["lo"], row["hi"], below, row["rows"], ranks, k=s.k))
            below += row["n"]
    return out


def _read_ranks(held: DataFrame, spans: list[_Span]) -> dict[tuple[int, int], float]:
    """Order the few values left in each span and pick the wanted ranks."""
    found = {}
    for start in range(0, len(spans), 100):
        part = spans[start:start + 100]
        upto = F.sum("n").over(W.partitionBy("s").orderBy("v"))  # at most ``final_rows`` rows
        rows = _in_spans(held, part).select("s", "v", "n", upto.alias("upto"))
        wanted = [
            F.min(F.when((F.col("s") == i) & (F.col("upto") > r - s.below), F.col("v"))).alias(f"s{i}_{r}")
            for i, s in enumerate(part) for r in s.ranks
        ]
        row = rows.agg(*wanted).first()
        found.update({(s.col, r): row[f"s{i}_{r}"] for i, s in enumerate(part) for r in s.ranks})
    return found
