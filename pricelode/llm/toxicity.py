"""Toxicity scores: gradient-boosted trees over dense features of the whole text, with isotonic calibration.

The lexicon is learned too: words, and beginnings of words for inflected ones, that occur far more often in texts labelled
toxic. Lexicon, trees and calibration are
fitted on a bounded sample of labelled rows (``SAMPLE``, taken by a hash of the id); every row is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.llm.corpus import small_batches, texts, utf8
from pricelode.llm.steps import written

#: Labelled rows that the model is fitted on at most, and words in its lexicon at most.
SAMPLE, LEXICON = 16_000, 200
#: A lexicon word is in at least this share of the toxic texts and this many of them, and this many times as common there as
#: elsewhere.
SHARE, LEAST, ODDS = 0.02, 3, 6.0
#: Words whose weight a task remembers.
REMEMBERED = 100_000
#: Bytes of the beginnings of words that the lexicon may hold.
STEMS = range(4, 8)
#: Words around a lexicon word in which a second person counts.
NEAR = 5
TREES, DEPTH, RATE, BINS, FOLDS = 80, 3, 0.15, 32, 3
#: Terms that a task counts before it hands their numbers on.
COUNTED = 200_000

SECOND_PERSON = frozenset(
    "you your yours yourself yourselves ya u ur du dich dir dein deine deiner deinen euch ihr tu te toi ton ta tes vous votre "
    "vos tú ti contigo usted ustedes vosotros".encode().split())
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACED = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
#: Digits and signs that stand for letters.
_PLAIN = bytes.maketrans(b"013457@$!", b"oieastasi")
_REMOVED = bytes(set(_PUNCTUATION) - set(b"@$!"))
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
_SHOUTED = re.compile(rb"\b[A-Z]{3,}\b")
_REPEATED = re.compile(rb"[!?]{2,}")
_MIXED = re.compile(rb"[A-Za-z][0-9@$!*]+[A-Za-z]")


def words_of(data: bytes) -> list[bytes]:
    return data.lower().translate(_SPACED).split()


def terms_of(word: bytes) -> list[bytes]:
    """What of a word the lexicon may hold: the word, and its beginnings, marked as such."""
    return [word, *(word[:n] + b"*" for n in STEMS if n < len(word))]


class Lexicon(dict):
    """Weights of words: the greatest of their terms, 0 where none is held; remembers words up to a bound."""

    def __init__(self, terms: dict[bytes, float]):
        super().__init__()
        self.terms = terms

    def __missing__(self, word: bytes) -> float:
        weight = max((self.terms[t] for t in terms_of(word) if t in self.terms), default=0.0)
        if len(self) < REMEMBERED:
            self[word] = weight
        return weight

    def __reduce__(self):
        return Lexicon, (self.terms,)


def features(data: bytes, lexicon: Lexicon) -> list[float]:
    """Dense features of one text; all zero but the length where there are no words."""
    found = words_of(data)
    n = max(1, len(found))
    weight = list(map(lexicon.__getitem__, found))
    hits = [i for i, x in enumerate(weight) if x]
    people = [i for i, w in enumerate(found) if w in SECOND_PERSON]
    near = 0
    if people and hits:
        at, own = np.array(people), np.array(hits)
        near = int((np.searchsorted(at, own + NEAR, "right") > np.searchsorted(at, own - NEAR)).sum())
    plain = data.lower().translate(_PLAIN, _REMOVED).split()
    hidden = max(0, sum(map(bool, map(lexicon.__getitem__, plain))) - len(hits))
    letters = len(data) - len(data.translate(None, _LETTERS))
    weights = [weight[i] for i in hits]
    return [
        100 * len(hits) / n, 100 * sum(weights) / n, float(len({found[i] for i in hits})), math.log1p(len(hits)),
        max(weights, default=0.0), 100 * near / n, 100 * len(people) / n,
        (len(data) - len(data.translate(None, _UPPER))) / max(1, letters), 100 * len(_SHOUTED.findall(data)) / n,
        100 * (data.count(b"!") + data.count(b"?")) / n, 100 * len(_REPEATED.findall(data)) / n,
        (len(data) - len(data.translate(None, _PUNCTUATION))) / max(1, len(data)), 100 * hidden / n, float(hidden),
        100 * len(_MIXED.findall(data)) / n, math.log1p(len(found))]


class Trees:
    """Boosted regression trees on binned features for the logistic loss; each tree is complete to its depth."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        bins = self._binned(x)
        score = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            self.trees.append(self._grow(bins, y - p, p * (1 - p)))
            score += RATE * self._one(bins, self.trees[-1])

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _grow(self, bins: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        feature, cut = np.zeros(2**DEPTH, np.int64), np.full(2**DEPTH, BINS, np.int64)  # a cut at BINS sends all to the left
        node = np.ones(len(bins), np.int64)
        for level in range(DEPTH):
            size = 2**level
            best = np.full(size, 1e-6)
            for f in range(bins.shape[1]):
                at = (node - size) * BINS + bins[:, f]
                g = np.bincount(at, gradient, size * BINS).reshape(size, BINS).cumsum(axis=1)
                h = np.bincount(at, weight, size * BINS).reshape(size, BINS).cumsum(axis=1)
                rest_g, rest_h = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + 1) + rest_g**2 / (rest_h + 1) - (g[:, -1:]**2 / (h[:, -1:] + 1))
                gain[(h < 1) | (rest_h < 1)] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(size), top] > best
                best[better] = gain[np.arange(size), top][better]
                feature[size:2 * size][better], cut[size:2 * size][better] = f, top[better]
            node = 2 * node + (bins[np.arange(len(bins)), feature[node]] > cut[node])
        leaf = node - 2**DEPTH
        return feature, cut, np.bincount(leaf, gradient, 2**DEPTH) / (np.bincount(leaf, weight, 2**DEPTH) + 1)

    @staticmethod
    def _one(bins: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        node = np.ones(len(bins), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + (bins[np.arange(len(bins)), feature[node]] > cut[node])
        return value[node - 2**DEPTH]

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = self._binned(x)
        return self.base + RATE * sum((self._one(bins, t) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nondecreasing step function of the score nearest to ``y``: pools neighbours that are out of order."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, number, least and greatest score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1, s, s])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            last = blocks.pop()
            blocks[-1][0] += last[0]
            blocks[-1][1] += last[1]
            blocks[-1][3] = last[3]
    at = np.array([x for b in blocks for x in (b[2], b[3])])
    return at, np.array([b[0] / b[1] for b in blocks for _ in range(2)])


class Model:
    """Lexicon, trees and calibration; a constant where the labels are all alike.

    ``x[0]`` are the features under the lexicon of all rows, ``x[1 + k]`` those under the lexicon of the rows outside fold
    ``k``. A row is calibrated by the score of lexicon and trees that have not seen its fold.
    """

    def __init__(self, lexicon: Lexicon, x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        self.lexicon, self.constant = lexicon, float(y.mean()) if len(y) else 0.0
        self.trees = None
        if 0 < self.constant < 1:
            out = np.zeros(len(y))
            for k in range(FOLDS):
                rest, own = fold != k, x[1 + k]
                out[~rest] = Trees(own[rest], y[rest]).raw(own[~rest]) if 0 < y[rest].sum() < rest.sum() else self.constant
            self.at, self.share = isotonic(out, y)
            self.trees = Trees(x[0], y)

    def score(self, batch: list[bytes]) -> np.ndarray:
        if self.trees is None or not batch:
            return np.full(len(batch), self.constant)
        x = np.array([features(d, self.lexicon) for d in batch])
        return np.clip(np.interp(self.trees.raw(x), self.at, self.share), 0.0, 1.0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(term, fold, toxic, clean)``: how many texts ``(doc_id, text, y, fold)`` of each label hold a term, a bounded number
    of terms at a time."""
    seen: Counter = Counter()

    def rows() -> pa.RecordBatch:
        terms, folds, marks = zip(*seen, strict=True) if seen else ((), (), ())
        n, toxic = np.array(list(seen.values()), np.int64), np.array(marks, bool)
        seen.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.binary()), pa.array(folds, pa.int32()), pa.array(n * toxic), pa.array(n * ~toxic)],
            ["term", "fold", "toxic", "clean"])

    for batch in batches:
        for data, y, fold in zip(utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            seen.update((t, fold, y) for t in {t for w in set(words_of(data or b"")) for t in terms_of(w)})
            if len(seen) >= COUNTED:
                yield rows()
    yield rows()


def _lexicons(sample: DataFrame) -> list[Lexicon]:
    """The lexicon of all rows of ``sample(doc_id, text, y, fold)``, then for each fold that of the rows outside it."""
    per_fold = sample.groupBy("fold").agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).collect()
    toxic, clean = ({r[0]: r[i] for r in per_fold} for i in (1, 2))
    outside = lambda name, k: F.sum(F.when(F.col("fold") != k, F.col(name)).otherwise(0))
    every = range(-1, FOLDS)  # no row is of fold -1
    terms = written(
        sample.mapInArrow(_counted, "term binary, fold int, toxic long, clean long").groupBy("term")
        .agg(*(outside(name, k).alias(f"{name}{k + 1}") for name in ("toxic", "clean") for k in every))
        .where(F.col("toxic0") >= LEAST))
    out = []
    for k in every:
        n1, n0 = (sum(n for fold, n in of.items() if fold != k) for of in (toxic, clean))
        held = F.col(f"toxic{k + 1}")
        odds = (held + 0.5) / (n1 + 1) / ((F.col(f"clean{k + 1}") + 0.5) / (n0 + 1))
        top = (
            terms.where((held >= max(LEAST, SHARE * n1)) & (odds >= ODDS)).select("term", F.log(odds).alias("weight"), held.alias("n"))
            .orderBy(F.desc(F.col("weight") * F.col("n")), "term").limit(LEXICON).collect())
        out.append(Lexicon({bytes(r["term"]): float(r["weight"]) for r in top}))
    return out


def fitted(docs: DataFrame, labels: DataFrame, allowed: Column, label_col: str = "toxic") -> Model:
    """A model from at most ``SAMPLE`` rows of ``docs(doc_id, text)`` that ``labels`` marks 0 or 1 and ``allowed`` admits.

    Of texts that share an id the one of smallest MD5 counts; an id that is marked both 0 and 1 counts as 1."""
    marks = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y"))
        .where("doc_id IS NOT NULL AND y IN (0, 1)").where(allowed).groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    sample = written(
        docs.join(F.broadcast(marks), "doc_id").groupBy("doc_id", "y").agg(F.min_by(text, F.md5(text.cast("binary"))).alias("text"))
        .select("doc_id", "text", "y", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int").alias("fold")))
    lexicons = _lexicons(sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [list(chain.from_iterable(features(d, x) for x in lexicons)) for d in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "y", "fold", "x"])

    rows = sample.mapInArrow(measure, "doc_id long, y int, fold int, x array<double>").toPandas()  # at most SAMPLE rows
    rows = rows.sort_values("doc_id", ignore_index=True)  # here, as a sort in Spark would measure twice for its ranges
    x = np.array(rows["x"].tolist()).reshape(len(rows), len(lexicons), -1).transpose(1, 0, 2) if len(rows) else np.empty((0, 0, 0))
    return Model(lexicons[0], x, rows["y"].to_numpy(float), rows["fold"].to_numpy())


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` for each row: the calibrated share of toxic texts, and whether it is 0.5 or more.

    A null text counts as empty and is scored like any other; so are rows without an id or that repeat. An empty table
    gives no rows; other columns are ignored. Row-local: no shuffle.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score([d or b"" for d in utf8(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))],
                                             ["doc_id", "score", "predicted"])

    return texts(docs, id_col, text_col).mapInArrow(score, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores under 0.5."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score([d or b"" for d in utf8(batch.column(text_col))])
            yield batch.filter(pa.array(s < 0.5))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from fitting: the remainder of its id's checksum is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
