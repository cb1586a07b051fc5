"""Quality scores: a factorisation machine over hashed words, structure statistics and metadata.

Every pair of features interacts through the product of two short vectors. The sum over all pairs is half the difference between
the square of the features' sum and the sum of their squares, so a text is scored in time linear in its features. The machine is
fitted on a bounded sample of labelled rows (``SAMPLE``, taken by a hash of the id); every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.llm.corpus import chunks, mixed, shingle_hashes, small_batches, words_in
from pricelode.llm.steps import written

#: Labelled rows that the machine is fitted on at most; they come to the driver as features.
SAMPLE = 8_000
#: Buckets of hashed words, and quantile bins of each statistic.
BUCKETS, BINS = 1 << 12, 12
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 12, 64, 0.08, 1e-5
#: Words in the runs whose repetition counts.
RUN = 3
#: Weight of a statistic's bin next to all words of a text, whose weights have length one.
STATISTIC = 0.5

_CLASSES = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": b"0123456789", "symbol": b"#*$%&|<>~^_=+@\\/{}[]",
    "mark": b".,;:?'\"()-", "shout": b"!", "line": b"\n", "wide": bytes(range(128, 256))}
STATISTICS = ("words", "word bytes", "upper", "digit", "symbol", "mark", "shout", "wide", "lines", "words a line", "different words",
              "repeated runs", "commonest")


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_TABLES = {name: _table(members) for name, members in _CLASSES.items()}


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, buckets, weights, statistics)`` for runs of rows: the hashed words of each row with weights of length one, as
    triples ordered by row (counted from the run's first), and one line of statistics per row."""
    for _, data, bounds in chunks(column):
        n = len(bounds) - 1
        hashes, places = words_in(data, bounds)
        count = np.diff(places)
        row = np.repeat(np.arange(n), count)
        key, times = np.unique(row * BUCKETS + (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), return_counts=True)
        owner, bucket = key // BUCKETS, key % BUCKETS
        weight = np.log1p(times)
        length = np.sqrt(np.bincount(owner, weight**2, n))
        yield owner, bucket, weight / length[owner], _statistics(data, bounds, hashes, places, count, row)


def _statistics(data: np.ndarray, bounds: np.ndarray, hashes: np.ndarray, places: np.ndarray, count: np.ndarray, row: np.ndarray) -> np.ndarray:
    n, size, words = len(count), np.maximum(1, np.diff(bounds)), np.maximum(1, count)
    share = {}
    for name, members in _TABLES.items():
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(members[data])])
        share[name] = before[bounds[1:]] - before[bounds[:-1]]
    letters = np.maximum(1, share["upper"] + share["lower"])
    own = mixed(hashes ^ mixed(row.astype(np.uint64) + np.uint64(1)))  # words of different rows differ
    _, at, times = np.unique(own, return_index=True, return_counts=True)
    commonest = np.zeros(n, np.int64)
    np.maximum.at(commonest, row[at], times)
    runs = shingle_hashes(own, RUN) if len(own) >= RUN else own[:0]
    inside = row[:len(runs)] == row[len(own) - len(runs):]
    _, first = np.unique(runs[inside], return_index=True)
    owner = row[:len(runs)][inside]
    all_runs, different_runs = np.bincount(owner, minlength=n), np.bincount(owner[first], minlength=n)
    return np.stack([
        np.log1p(count), size / words, share["upper"] / letters, share["digit"] / size, share["symbol"] / size, share["mark"] / size,
        share["shout"] / size, share["wide"] / size, np.log1p(share["line"]), words / (share["line"] + 1),
        np.bincount(row[at], minlength=n) / words, 1 - different_runs / np.maximum(1, all_runs), commonest / words], axis=1)


def magnitudes(metadata: Sequence[pa.Array], rows: int) -> np.ndarray:
    """``(rows, columns)``: numbers from outside the text by order of magnitude, 0 where there is none; two a doubling, 99 at most."""
    out = np.zeros((rows, len(metadata)), np.int64)
    for i, column in enumerate(metadata):
        x = column.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
        out[:, i] = np.where(np.isfinite(x), np.clip(1 + 2 * np.log2(1 + np.maximum(0, np.nan_to_num(x, posinf=0, neginf=0))), 1, 99), 0)
    return out


def squares(owner: np.ndarray, rows: int, feature: np.ndarray, value: np.ndarray, bias: float, weight: np.ndarray,
            factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of ``rows`` sparse rows before the logistic step, and each row's sum of weighted factors; linear in the features."""
    scaled = factors[feature] * value[:, None]
    total = np.stack([np.bincount(owner, scaled[:, k], rows) for k in range(factors.shape[1])], axis=1)
    square = np.bincount(owner, (scaled**2).sum(axis=1), rows)
    linear = np.bincount(owner, weight[feature] * value, rows)
    return bias + linear + ((total**2).sum(axis=1) - square) / 2, total


class Machine:
    """Bins of the statistics, bias, weights and factors; a constant where the labels are all alike.

    Features are numbered: buckets of words, then bins by statistic, then magnitudes by metadata column.
    """

    def __init__(self, y: np.ndarray, owner: np.ndarray, bucket: np.ndarray, value: np.ndarray, statistics: np.ndarray, magnitude: np.ndarray):
        rate = float(y.mean()) if len(y) else 0.0
        self.constant = rate if rate in (0.0, 1.0) else None
        if self.constant is not None:
            return
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in statistics.T]
        owner, feature, value = self._joined(owner, bucket, value, statistics, magnitude)
        n = BUCKETS + BINS * statistics.shape[1] + 100 * magnitude.shape[1]
        r = np.random.default_rng(0)
        self.bias, self.weight, self.factors = float(np.log(rate / (1 - rate))), np.zeros(n), r.normal(0, 0.05, (n, FACTORS))
        self._fit(y, owner, feature, value, r)

    def _joined(self, owner, bucket, value, statistics, magnitude) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All features of the rows, ordered by row."""
        n = len(statistics)
        bins = [BUCKETS + BINS * i + np.searchsorted(e, statistics[:, i]) for i, e in enumerate(self.edges)]
        start = BUCKETS + BINS * len(self.edges)
        bins += [start + 100 * i + magnitude[:, i] for i in range(magnitude.shape[1])]
        owner = np.concatenate([owner, *(np.arange(n) for _ in bins)])
        order = np.argsort(owner, kind="stable")
        feature = np.concatenate([bucket, *bins])
        value = np.concatenate([value, np.full(n * len(bins), STATISTIC)])
        return owner[order], feature[order], value[order]

    def _fit(self, y: np.ndarray, owner: np.ndarray, feature: np.ndarray, value: np.ndarray, r: np.random.Generator) -> None:
        """Gradient steps on the logistic loss, each feature's size by the squares of its gradients so far."""
        bounds = np.searchsorted(owner, np.arange(len(y) + 1))
        seen_w, seen_v, seen_b = np.full(len(self.weight), 1e-8), np.full(self.factors.shape, 1e-8), 1e-8
        for _ in range(EPOCHS):
            order = r.permutation(len(y))
            for at in range(0, len(order), BATCH):
                rows = order[at:at + BATCH]
                size = bounds[rows + 1] - bounds[rows]
                own = np.repeat(np.arange(len(rows)), size)
                place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(bounds[rows], size)
                f, v = feature[place], value[place]
                score, total = squares(own, len(rows), f, v, self.bias, self.weight, self.factors)
                error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[rows]) / len(rows)
                touched, back = np.unique(f, return_inverse=True)
                step = error[own] * v
                g = np.bincount(back, step, len(touched)) + DECAY * self.weight[touched]
                seen_w[touched] += g**2
                self.weight[touched] -= RATE * g / np.sqrt(seen_w[touched])
                pull = step[:, None] * (total[own] - self.factors[f] * v[:, None])
                h = np.stack([np.bincount(back, pull[:, k], len(touched)) for k in range(FACTORS)], axis=1) + DECAY * self.factors[touched]
                seen_v[touched] += h**2
                self.factors[touched] -= RATE * h / np.sqrt(seen_v[touched])
                b = error.sum()
                seen_b += b**2
                self.bias -= RATE * b / np.sqrt(seen_b)

    def score(self, texts: pa.Array, metadata: Sequence[pa.Array] = ()) -> np.ndarray:
        if self.constant is not None or not len(texts):
            return np.full(len(texts), self.constant or 0.0)
        magnitude, out = magnitudes(metadata, len(texts)), []
        for owner, bucket, value, statistics in features(texts):
            at = sum(map(len, out))
            owner, feature, value = self._joined(owner, bucket, value, statistics, magnitude[at:at + len(statistics)])
            score, _ = squares(owner, len(statistics), feature, value, self.bias, self.weight, self.factors)
            out.append(1 / (1 + np.exp(-np.clip(score, -30, 30))))
        return np.concatenate(out)


def fitted(docs: DataFrame, labels: DataFrame, allowed: Column, metadata: Sequence[str] = (), label_col: str = "quality",
           id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """A machine from at most ``SAMPLE`` ids that ``labels(doc_id, ...)`` marks 0 or 1 and ``allowed`` admits.

    Of rows that repeat an id the one of the smallest text counts, of labels that repeat one the greater. ``metadata`` are
    numeric columns of ``docs``.
    """
    marks = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y"))
        .where("doc_id IS NOT NULL AND y IN (0, 1)").where(allowed).groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    own = F.struct(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
                   *(docs[c].cast("double").alias(f"m{i}") for i, c in enumerate(metadata))).alias("row")
    small_batches(docs.sparkSession)
    sample = written(docs.select(docs[id_col].cast("long").alias("doc_id"), own).join(F.broadcast(marks), "doc_id")
                     .groupBy("doc_id", "y").agg(F.min("row").alias("row")).select("doc_id", "y", "row.*"))  # at most SAMPLE rows

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            magnitude, done = magnitudes(batch.columns[3:], batch.num_rows), 0
            for owner, bucket, value, statistics in features(batch.column(2)):
                n = len(statistics)
                bounds = pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[done:done + n], batch.column(1)[done:done + n],
                    pa.ListArray.from_arrays(bounds, pa.array(bucket, pa.int32())),
                    pa.ListArray.from_arrays(bounds, pa.array(value, pa.float32())),
                    pa.array(statistics.tolist(), pa.list_(pa.float64())),
                    pa.array(magnitude[done:done + n].tolist(), pa.list_(pa.int32()))], ["doc_id", "y", "bucket", "value", "statistics", "magnitude"])
                done += n

    rows = sample.mapInArrow(measure, "doc_id long, y int, bucket array<int>, value array<float>, statistics array<double>, magnitude "
                             "array<int>").orderBy("doc_id").toArrow().combine_chunks()
    sizes = rows["bucket"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)

    def flat(name: str) -> np.ndarray:
        return rows[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)

    n = rows.num_rows
    return Machine(rows["y"].to_numpy().astype(float), np.repeat(np.arange(n), sizes), flat("bucket").astype(np.int64),
                   flat("value").astype(float), flat("statistics").reshape(n, len(STATISTICS)), flat("magnitude").reshape(n, len(metadata)))


def scored(docs: DataFrame, machine: Machine, metadata: Sequence[str] = (), at: float = 0.3, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` for each row: how likely label 1 is, and whether the score is ``at`` or more.

    A null text counts as empty and is scored like any other; so are rows without an id or that repeat, and metadata that are
    null. An empty table gives no rows; other columns are ignored. Row-local: no shuffle.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = machine.score(batch.column(1), batch.columns[2:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= at).astype(np.int32))],
                                             ["doc_id", "score", "predicted"])

    small_batches(docs.sparkSession)
    own = [docs[c].cast("double").alias(f"m{i}") for i, c in enumerate(metadata)]
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *own).mapInArrow(
        score, "doc_id long, score double, predicted int")
