"""Spelling variants: words of a vocabulary that differ by one edit, found by composing acceptors.

The minimal acceptor of the vocabulary is composed with a transducer that copies symbols and makes one edit, and with the acceptor
again. What the composed machine accepts are the pairs one edit apart. Before the edit both acceptors are in the same state; that
state is what the work is partitioned by: two words whose edit lies in their second half share the state behind the first half,
and the others share the state behind the second half when read backwards.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from os.path import commonprefix
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.llm.corpus import texts, utf8
from pricelode.llm.steps import written

#: Words that share a state and are composed in one task; larger groups start behind the edit instead.
GROUP = 4_096
#: Words, and characters of words, that a task counts before it hands them on.
COUNTED, CHARACTERS = 200_000, 1 << 24
_RUN = re.compile("[a-zÀ-ÿ]+")
_KEY = ["side", "m", "half"]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 5, least: int = 3,
               slips: int | None = None) -> DataFrame:
    """``(word, n)``: runs of Latin letters, A-Z lower-cased, of at least ``length`` characters that occur ``least`` times.

    With ``slips``, a run whose checksum with its document's id is divisible by that number loses one character first, as a
    typing slip would; the place comes from the checksum too. A missing id counts as an empty one.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        held = 0
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(_RUN.findall((data or b"").lower().decode())).items():  # bytes: only A-Z change
                    if len(run) < length:
                        continue
                    if slips and (h := crc32(run.encode(), start)) % slips == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                        if len(run) < length:
                            continue
                    if run not in seen:
                        held += len(run)
                    seen[run] += n
                    if len(seen) >= COUNTED or held >= CHARACTERS:
                        yield _counts(seen)
                        seen, held = Counter(), 0
        yield _counts(seen)

    return texts(docs, id_col, text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")).where(F.col("n") >= least)


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


class Acceptor:
    """The minimal acyclic acceptor of sorted different words; a state's arcs lead to states of smaller number."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        self._both: dict[tuple[int, int, str], list[str]] = {}
        path: list[tuple[dict[str, int], bool]] = [({}, False)]
        last = ""
        for word in words:
            same = len(commonprefix((last, word)))
            self._close(path, last, same)
            path += [({}, False) for _ in range(len(word) - same)]
            path[-1] = (path[-1][0], True)
            last = word
        self._close(path, last, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list, word: str, keep: int) -> None:
        while len(path) > keep + 1:
            arcs, final = path.pop()
            path[-1][0][word[len(path) - 1]] = self._state(arcs, final)

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        key = (final, *arcs.items())
        if key not in self._known:
            self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return self._known[key]

    def both(self, s: int, t: int, but: str = "") -> list[str]:
        """What is accepted from both states and does not begin with ``but``."""
        found = self._both.get((s, t, but))
        if found is not None:
            return found
        found, symbols, open_ = [], [], [(s, t, 0, "")]
        while open_:
            x, y, depth, symbol = open_.pop()
            if depth:
                symbols[depth - 1:] = symbol
            if self.final[x] and self.final[y]:
                found.append("".join(symbols[:depth]))
            a, b = self.arcs[x], self.arcs[y]
            open_ += [(a[c], b[c], depth + 1, c) for c in a if c in b and (depth or c != but)]
        self._both[s, t, but] = found
        return found

    def edits(self, state: int) -> list[tuple[str, str]]:
        """Pairs accepted from ``state`` whose edit is its next symbol: one replaced, or one too many on the left.

        Of equal symbols in a row the last one is the one too many, so that a pair comes once.
        """
        arcs = list(self.arcs[state].items())
        found = [(a + z, b + z) for i, (a, s) in enumerate(arcs) for b, t in arcs[i + 1:] for z in self.both(s, t)]
        return found + [(a + z, z) for a, s in arcs for z in self.both(s, state, a)]

    def pairs(self) -> Iterator[tuple[str, str]]:
        """All pairs of accepted words one edit apart, once each."""
        edits = [self.edits(q) for q in range(len(self.arcs))]
        alive: list[bool] = []  # whether an edit can still come; the other states are cut away
        for q, arcs in enumerate(self.arcs):
            alive.append(bool(edits[q]) or any(alive[s] for s in arcs.values()))
        symbols: list[str] = []
        open_ = [(self.start, 0, "")]
        while open_:
            q, depth, symbol = open_.pop()
            if depth:
                symbols[depth - 1:] = symbol
            if edits[q]:
                before = "".join(symbols[:depth])
                yield from ((before + x, before + y) for x, y in edits[q])
            open_ += [(s, depth + 1, c) for c, s in self.arcs[q].items() if alive[s]]


def composed(side: int, m: int, half: str, words: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs of words one edit apart, the shorter (or each) of ``m`` characters, that share ``half`` at their beginning
    (``side`` 0) or share it at their end and have their edit before the middle (``side`` 1)."""
    cut = len(half)
    if side == 0:
        for x, y in Acceptor(sorted(w[cut:] for w in words)).pairs():
            if cut + min(len(x), len(y)) == m:
                yield half + x, half + y
        return
    for x, y in Acceptor(sorted(w[:-cut][::-1] for w in words)).pairs():
        if cut + min(len(x), len(y)) == m:
            x, y = x[::-1] + half, y[::-1] + half
            if len(commonprefix((x, y))) < m // 2:
                yield x, y


_PAIRS = "word string, n long, near string, near_n long"


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come ordered by state, as pairs."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    out: list[tuple] = []
    for (side, m, half), group in groupby(rows, key=lambda r: r[:3]):
        counts = {r[3]: r[4] for r in group}
        if len(counts) > 1:
            for x, y in composed(side, m, half, list(counts)):
                out += [(x, counts[x], y, counts[y]), (y, counts[y], x, counts[x])]
        if len(out) >= 10_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    types = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["word", "n", "near", "near_n"])


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``(word, n, near, near_n)``: every pair of the different words of ``words(word, n)`` that are one edit apart, both ways.

    Words of one character have no halves and words shorter than two take no part. Every word goes to four states: its first
    and its second half, as the shorter and as the longer word of a pair.
    """
    size = F.length("word")
    half = F.floor(F.col("m") / 2).cast("int")
    sided = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where("m >= 2").select(
        "m", "word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    tail = F.col("m") - half
    keyed = sided.select("side", "m", F.when(F.col("side") == 0, F.substr("word", F.lit(1), half)).otherwise(
        F.substr("word", size - tail + 1, tail)).alias("half"), "word", "n")
    several = written(keyed.groupBy(*_KEY).agg(F.count("*").alias("words")).where("words > 1"))
    shared = keyed.join(several, _KEY).select(*_KEY, "word", "n", "words")
    small = shared.where(F.col("words") <= group).drop("words")
    found = small.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(_compose, _PAIRS)
    if several.where(F.col("words") > group).isEmpty():
        return found
    return found.unionByName(_behind_edits(shared.where(F.col("words") > group)))


def _behind_edits(large: DataFrame) -> DataFrame:
    """The pairs of groups that are too large for one task, from the states right behind each possible edit.

    What is accepted from such a state is one string, so that at most an alphabet of words meets there.
    """
    words = written(large.select("side", "m", "word", "n"))
    size, half = F.length("word"), F.floor(F.col("m") / 2).cast("int")
    at = F.when(F.col("side") == 0, F.sequence(half, size - 1)).otherwise(F.sequence(F.lit(0), half - 1))
    placed = words.select("side", "m", "word", "n", F.explode(at).alias("at"))
    before, after = F.substr("word", F.lit(1), F.col("at")), F.substr("word", F.col("at") + 2)
    last = F.substr("word", F.col("at") + 1, F.lit(1)) != F.substr("word", F.col("at") + 2, F.lit(1))  # of equal symbols in a row

    def hashed(*parts: Column) -> Column:
        return F.xxhash64("side", "m", *parts).alias("state")

    same = placed.where(F.length("word") == F.col("m")).select(hashed("at", before, after), "word", "n")
    more = placed.where((F.length("word") > F.col("m")) & last).select(hashed(F.concat(before, after)), "word", "n")
    whole = words.where(F.length("word") == F.col("m")).select(hashed(F.col("word")), "word", "n")

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.select(F.col("state").alias("s"), F.col("word").alias("near"), F.col("n").alias("near_n"))
        return left.join(other, F.col("state") == F.col("s")).where(F.levenshtein("word", "near") == 1).select("word", "n", "near", "near_n")

    back = [F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")]
    longer = met(more, whole)
    return met(same, same).unionByName(longer).unionByName(longer.select(*back))


def grouped(words: DataFrame, group: int = GROUP, ratio: int = 2) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each row of ``words(word, n)``, whose words differ.

    A word's form is the commonest of the words one edit away (of equally common ones the smallest), if that is at least
    ``ratio`` times (more than one) as common; else null. Its root is where following forms ends. An empty vocabulary gives no rows.
    """
    if ratio < 2:
        raise ValueError("forms need to be commoner than their words")
    words = written(words.select("word", "n"))
    near = near_pairs(words, group).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    common = -F.col("best.n") >= ratio * F.col("n")
    formed = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(common, F.col("best.word")).alias("form"), F.when(common, -F.col("best.n")).alias("form_n")))
    roots = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # forms are at least twice as common as their words, so chains are short, and each round halves what is left
        roots = written(roots)
        further = roots.select(F.col("word").alias("w"), F.col("root").alias("r"))
        joined = roots.join(further, F.col("root") == F.col("w"), "left")
        if joined.where("r IS NOT NULL").isEmpty():
            break
        roots = joined.select("word", F.coalesce("r", "root").alias("root"))
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 5, least: int = 3,
             slips: int | None = None, group: int = GROUP) -> DataFrame:
    """The words of the documents with their spelling variants, see ``vocabulary`` and ``grouped``.

    Null and empty texts have no words; rows that repeat and rows without an id count like any other. An empty table gives no
    rows; other columns are ignored.
    """
    return grouped(vocabulary(docs, id_col, text_col, length, least, slips), group)
