"""Quality rules on repetition, from a suffix array over the words of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pricelode.llm.corpus import texts, utf8, word_hashes

#: Words that one suffix array covers: whole documents are added up to this many. A longer document has its own.
WORDS = 400_000
SYMBOLS = "#*$%&|<>"
WHITE_SPACE = "\x20\x09\x0A\x0B\x0C\x0D"

_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("longest_repeat", pa.int64()),
    ("spans", pa.list_(pa.list_(pa.int32()))), ("base_failed", pa.bool_()), ("kept", pa.bool_())])
_COLUMNS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "longest_repeat long, spans array<array<int>>, base_failed boolean, kept boolean")


def suffix_levels(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix ranks of many word sequences laid end to end, by prefix doubling.

    ``words`` are numbers that differ between sequences, ``ends`` the end of each place's sequence. The last ranks order the
    suffixes; level ``k`` has equal ranks where the next ``2**k`` words are equal. Only places that still tie are sorted
    again.
    """
    n = len(words)
    _, group, count = np.unique(words, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count)[group]
    levels = [rank.astype(np.int32)]
    tied = np.flatnonzero(count[group] > 1)
    step = 1
    while len(tied):
        after = tied + step
        inside = after < ends[tied]
        key = rank[tied] * (n + 1) + np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        old = rank[tied]
        at = np.arange(len(tied))
        of_old = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), at, 0))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        of_new = np.maximum.accumulate(np.where(new, at, 0))
        rank[tied] = old + of_new - of_old
        levels.append(rank.astype(np.int32))
        number = np.cumsum(new) - 1
        tied = tied[np.bincount(number)[number] > 1]
        step *= 2
    return rank, levels


def longest_repeats(words: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """For each place the words of the longest string starting there that its sequence has again; 0 if under ``least``.

    That is the greater of the common prefixes with the two neighbours in the suffix array: the innermost interval of the
    longest-common-prefix table that the suffix lies in.
    """
    n = len(words)
    out = np.zeros(n, np.int64)
    if n == 0:
        return out
    rank, levels = suffix_levels(words, ends)
    base = min(len(levels) - 1, max(0, least.bit_length() - 1))  # a repeat of `least` words is one of 2**base words too
    _, group, count = np.unique(levels[base], return_inverse=True, return_counts=True)
    suffixes = np.flatnonzero(count[group] > 1)
    if not len(suffixes) or 2**base > least:
        return out
    suffixes = suffixes[np.argsort(rank[suffixes], kind="stable")]
    left, right = suffixes[:-1], suffixes[1:]
    same = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + same, right + same
        fits = (a + 2**k <= ends[left]) & (b + 2**k <= ends[right])
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        same += np.where(fits & (levels[k][a] == levels[k][b]), 2**k, 0)
    # Level ranks tell 2**k words apart up to the last level, at which no two suffixes tie; so one pass is enough.
    best = np.maximum(np.append(same, 0), np.insert(same, 0, 0))
    out[suffixes] = np.where(best >= least, best, 0)
    return out


def maximal_spans(repeat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal repeated strings: those that the string one place earlier doesn't hold as its end."""
    before = np.concatenate([[0], repeat[:-1]])
    start = np.flatnonzero((repeat > 0) & (before < repeat + 1))
    return start, start + repeat[start]


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, least_words: int = 20,
          most_repeated: int = 30, most_covered: int = 25, longest: int = 50) -> DataFrame:
    """Counts, repeated spans and verdict for each row of ``docs``.

    Words are runs of anything but ASCII white space, as they are. ``spans`` are the word ranges ``[start, end)`` that
    repeated strings of at least ``window`` words cover, ``n_repeat_words`` their words, ``longest_repeat`` the words of the
    longest. ``base_failed``: fewer than ``least_words`` words, or more than ``most_repeated`` per cent of them repeated.
    ``kept``: not failed, at most ``most_covered`` per cent of the words covered, and no repeat longer than ``longest``.

    A null or empty text has no words and fails. Every input row gives a row, whatever its id; other columns are ignored.
    Row-local: no shuffle. A task holds the suffix array of at most ``WORDS`` words, or of one longer document.
    """
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            rows = zip(batch.column(0).to_pylist(), utf8(batch.column(1)), word_hashes(batch.column(1), lower=False), strict=True)
            for doc, data, words in rows:
                held.append((doc, data or b"", words))
                size += len(words)
                if size >= WORDS:
                    yield of(held)
                    held, size = [], 0
            if held:
                yield of(held)

    def of(held: list) -> pa.RecordBatch:
        counts = np.array([len(w) for _, _, w in held])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        sequence = np.repeat(np.arange(len(held)), counts)
        _, ids = np.unique(np.concatenate([w for _, _, w in held]), return_inverse=True)
        repeat = longest_repeats(sequence * (len(ids) + 1) + ids, np.repeat(bounds[1:], counts), window)
        starts, stops = maximal_spans(repeat)
        cuts = np.searchsorted(starts, bounds)
        rows = []
        for i, (doc, data, words) in enumerate(held):
            own = slice(cuts[i], cuts[i + 1])
            spans = merged(starts[own] - bounds[i], stops[own] - bounds[i])
            covered = sum(b - a for a, b in spans)
            most = int((stops[own] - starts[own]).max(initial=0))
            n = len(words)
            failed = n < least_words or 100 * covered > most_repeated * n
            rows.append((doc, n, *counted(data), covered, most, spans, failed,
                         not failed and 100 * covered <= most_covered * n and most <= longest))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)],
                                          schema=_SCHEMA)

    return texts(docs, id_col, text_col).mapInArrow(measure, _COLUMNS)


def counted(data: bytes) -> tuple[int, int, int]:
    """Code points in words, symbols, and lines with a word that repeat an earlier one."""
    text = data.decode("utf-8", "replace")
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (len(text) - sum(map(text.count, WHITE_SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)))


def merged(starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Overlapping or touching ranges, in order of their starts, as one."""
    out: list[list[int]] = []
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out
