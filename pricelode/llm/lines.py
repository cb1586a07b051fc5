"""Line dedup by an exact set-similarity join: removes lines similar to a line that stands earlier in the corpus.

1. A line's tokens are its distinct word shingles, ordered by rarity: how often the shingles of their bucket of a
   fixed-size count sketch occur in all lines, then by hash. Any fixed order is right; a rare-first one keeps lists short.
2. Lines with one and the same set are a class, which its first line stands for; its other lines go.
3. Classes are posted under the tokens of their prefix, long enough that similar lines share one. Pairs that share a
   prefix token pass the length filter, the positional filter and a filter of parities, and are confirmed on their full sets.
4. A class goes as soon as one earlier class is similar, so every class first meets the classes of the first document in
   each of its lists. Only those that found none meet the rest of their lists: short lists pair by pair, longer ones block
   against block on their full sets, where a task gives each line at most once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricelode.llm.corpus import carried_type, chunks, mixed, shingle_hashes, signed, texts, told_apart, utf8, word_hashes, words_in
from pricelode.llm.steps import written

#: Buckets of the rarity sketch, a power of two: its size does not depend on the corpus.
SKETCH = 1 << 16
#: Longer lists are compared in blocks, of so many lines at most on average.
SHORT, BLOCK = 32, 1_024
_COLUMNS = 4_096
_SALT = np.uint64(0xD6E8FEB86659FD93)
_ONE, _SIX, _SEVENTH = np.uint64(1), np.uint64(63), np.uint64(64)


class Cut:
    """The shingles of the lines of some texts: one hash per shingle, and the line with words it is from."""

    def __init__(self, docs: np.ndarray, data: np.ndarray, bounds: np.ndarray, size: int):
        starts = np.unique(np.concatenate([bounds[:-1], np.flatnonzero(data == 10) + 1]))
        starts = starts[starts < len(data)]  # a line that starts where its text ends has no words
        hashes, places = words_in(data, np.append(starts, len(data)))
        of = np.searchsorted(bounds[:-1], starts, "right") - 1  # of empty texts at the same place the last is not empty
        number = np.arange(len(starts)) - np.searchsorted(starts, bounds[:-1])[of]
        counts = np.diff(places)
        full = np.flatnonzero(counts)
        self.doc, self.number = docs[of[full]], number[full].astype(np.int32)
        counts, first = counts[full], places[:-1][full]
        several = np.maximum(counts - size + 1, 0)  # shingles of each line
        at = np.arange(several.sum()) + np.repeat(first - (np.cumsum(several) - several), several)  # where they start
        total = shingle_hashes(hashes, size)[at] if len(at) else np.empty(0, np.uint64)
        short = np.flatnonzero(counts < size)
        whole = [shingle_hashes(hashes[first[i]:first[i] + counts[i]], size)[0] for i in short]
        self.hash = np.concatenate([total, np.array(whole, np.uint64)])
        self.line = np.concatenate([np.repeat(np.arange(len(full)), several), short])


def _cuts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Cut]:
    for batch in batches:
        batch = batch.filter(batch.column(0).is_valid())
        docs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for row, data, bounds in chunks(batch.column(1)):
            yield Cut(docs[row:row + len(bounds) - 1], data, bounds, size)


def _shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    return (np.unique(shingle_hashes(w, size)) for w in word_hashes(column))


def rarity(docs: DataFrame, size: int) -> np.ndarray:
    """How many shingles of all lines fall into each bucket of the sketch, in 256 logarithmic steps."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for cut in _cuts(batches, size):
            total += np.bincount(signed(cut.hash & np.uint64(SKETCH - 1)), minlength=SKETCH)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    sums = docs.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SKETCH, np.int64)
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return np.minimum(255, np.log2(out + 1) * 5).astype(np.uint64)


def prefixes(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """``(doc_id, line, n, k1, k2, p1, p2, prefix)`` per line with a word: set size, 128 bits for the set, 128 parities, its
    rarest tokens. A parity tells whether an odd number of the set's tokens falls on it: those of two sets differ in no more
    places than there are tokens that only one of the sets has."""
    steps = rarity(docs, size)

    def cut_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in _cuts(batches, size):
            h, line = cut.hash, cut.line
            if not len(h):
                continue
            rare = steps[signed(h & np.uint64(SKETCH - 1))]
            bits = np.uint64(int(len(cut.doc)).bit_length())
            key = (line.astype(np.uint64) << (np.uint64(64) - bits)) | (rare << (np.uint64(56) - bits)) | (h >> (bits + np.uint64(8)))
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            if (h[order][1:][same] != h[order][:-1][same]).any():  # the key leaves out the lowest bits of the hash
                order = np.lexsort((h, rare, line))
            h, line = h[order], line[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (line[1:] != line[:-1])])
            h, line = h[new], line[new]
            starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))  # every line has a token
            n = np.diff(np.append(starts, len(h)))
            k1 = np.add.reduceat(mixed(h), starts)
            k2 = np.add.reduceat(mixed(h ^ _SALT), starts)
            bit, second = _ONE << (h & _SIX), (h & _SEVENTH) != 0  # a token falls on one of the 128
            p1 = np.bitwise_xor.reduceat(np.where(second, 0, bit), starts)
            p2 = np.bitwise_xor.reduceat(np.where(second, bit, 0), starts)
            length = n + num * n // -den + 1
            kept = np.arange(len(h)) - np.repeat(starts, n) < np.repeat(length, n)
            offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(cut.doc), pa.array(cut.number), pa.array(n.astype(np.int32)), pa.array(signed(k1)), pa.array(signed(k2)),
                pa.array(signed(p1)), pa.array(signed(p2)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(h[kept])))],
                ["doc_id", "line", "n", "k1", "k2", "p1", "p2", "prefix"])

    return docs.mapInArrow(
        cut_lines, "doc_id long, line int, n int, k1 long, k2 long, p1 long, p2 long, prefix array<long>")


def _line_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(doc_id, line, text)`` of the lines of ``wanted``."""
    numbers = wanted.groupBy("doc_id").agg(F.collect_list("line").alias("numbers"))  # no more than the document has lines
    lines = F.split("text", "\n", -1)
    return docs.join(numbers, "doc_id").select("doc_id", "numbers", lines.alias("lines")).select(
        "doc_id", "lines", F.explode("numbers").alias("line")).select(
        "doc_id", "line", F.get("lines", F.col("line")).alias("text"))


def _confirmed(pairs: DataFrame, line_texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Of pairs of lines ``(doc_id, line, doc_2, line_2)`` the first lines of those that are similar enough."""
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(*(_shingle_sets(batch.column(i), size) for i in (2, 3)), strict=True):
                common = len(np.intersect1d(a, b, assume_unique=True))
                good.append(den * common >= num * (len(a) + len(b) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    other = line_texts.select(F.col("doc_id").alias("doc_2"), F.col("line").alias("line_2"), F.col("text").alias("text_2"))
    rows = pairs.join(other, ["doc_2", "line_2"]).join(line_texts, ["doc_id", "line"])
    return rows.select("doc_id", "line", "text", "text_2").mapInArrow(confirm, "doc_id long, line int").distinct()


def _earlier_within(table: pa.Table, num: int, den: int) -> pa.Table:
    """Open lines of two blocks of one list that an earlier line of them is similar to.

    All intersections come from products of 0/1 matrices, a few shingles at a time; only shingles that several lines have
    take part.
    """
    doc, line = (table.column(c).to_numpy() for c in ("doc_id", "line"))
    order = np.lexsort((line, doc))
    doc, line, still = doc[order], line[order], table.column("still").to_numpy()[order]
    sets = [np.frombuffer(table.column("s")[i].as_py(), np.uint64) for i in order.tolist()]
    n = np.array([len(x) for x in sets])
    asks = np.flatnonzero(still)
    _, shingle, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[shingle] > 1
    number = np.cumsum(count > 1) - 1
    column, row = number[shingle[shared]], np.repeat(np.arange(len(sets)), n)[shared]
    by_column = np.argsort(column, kind="stable")
    column, row = column[by_column], row[by_column]
    common = np.zeros((len(asks), len(sets)), np.float32)
    for at in range(0, int(number[-1]) + 1, _COLUMNS):
        a, b = np.searchsorted(column, (at, at + _COLUMNS))
        has = np.zeros((len(sets), _COLUMNS), np.float32)
        has[row[a:b], column[a:b] - at] = 1
        common += has[asks] @ has.T
    common = common.astype(np.int64)
    similar = den * common >= num * (n[asks][:, None] + n[None, :] - common)
    similar &= (doc[None, :] < doc[asks][:, None]) | ((doc[None, :] == doc[asks][:, None]) & (line[None, :] < line[asks][:, None]))
    found = asks[similar.any(axis=1)]
    return pa.table([pa.array(doc[found]), pa.array(line[found])], ["doc_id", "line"])


def _block_matches(lists: DataFrame, line_texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Open lines with an earlier similar one, within long lists ``(token, doc_id, line, length, still)``."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in _shingle_sets(batch.column(2), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["doc_id", "line", "s"])

    of_line = line_texts.join(lists.select("doc_id", "line").distinct(), ["doc_id", "line"], "left_semi").select(
        "doc_id", "line", "text").mapInArrow(sets, "doc_id long, line int, s binary")
    blocks = F.ceil(F.col("length") / BLOCK)
    dealt = lists.withColumn("own", F.pmod(F.xxhash64("doc_id", "line"), blocks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return (
        dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "line", "still")
        .join(of_line, ["doc_id", "line"]).groupBy("token", "i", "j")
        .applyInArrow(lambda table: _earlier_within(table, num, den), "doc_id long, line int"))


def kept_lines(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """``(doc_id, line)`` of the lines with a word that stay; ``docs`` are ``(doc_id, text)``."""
    of_class = W.partitionBy("k1", "k2").orderBy("doc_id", "line")
    firsts = written(
        prefixes(docs, size, num, den).withColumn("place", F.row_number().over(of_class)).where("place = 1")
        .select("doc_id", "line", "n", "p1", "p2", "prefix"))
    parities = firsts.select("doc_id", "line", "n", "p1", "p2")
    posted = firsts.select("doc_id", "line", "n", F.posexplode("prefix").alias("place", "token"))
    lists = posted.groupBy("token").agg(F.count("*").alias("length"), F.min("doc_id").alias("head")).where("length > 1")
    listed = written(posted.join(lists, "token").select("token", "doc_id", "line", "n", "place", "head", "length"))
    line_texts = written(_line_texts(docs, listed.select("doc_id", "line").distinct()))

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        """Of lines that share a prefix token, those that come later with those that come earlier, without those whose parities
        differ in more places than similar sets can."""
        met = (
            x.alias("x").join(y.alias("y"), "token")
            .where("(y.doc_id < x.doc_id OR y.doc_id = x.doc_id AND y.line < x.line)")
            .where(f"{den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n)")
            .where(f"{num + den} * least(x.n - x.place, y.n - y.place) >= {num} * (x.n + y.n)")
            .selectExpr("x.doc_id", "x.line", "y.doc_id AS doc_2", "y.line AS line_2").distinct())
        other = parities.selectExpr("doc_id AS doc_2", "line AS line_2", "n AS m", "p1 AS q1", "p2 AS q2")
        return (
            met.join(other, ["doc_2", "line_2"]).join(parities, ["doc_id", "line"])
            .where(f"{num + den} * (bit_count(p1 ^ q1) + bit_count(p2 ^ q2)) <= {den - num} * (n + m)")
            .select("doc_id", "line", "doc_2", "line_2"))

    gone = written(_confirmed(pairs(listed, listed.where("doc_id = head")), line_texts, size, num, den))
    marked = listed.where("length > 2").join(gone.withColumn("gone", F.lit(True)), ["doc_id", "line"], "left").withColumn(
        "still", F.col("gone").isNull())
    short, rest = F.col("length") <= SHORT, F.col("doc_id") != F.col("head")
    more = _confirmed(pairs(marked.where(short & F.col("still")), listed.where(short & rest)), line_texts, size, num, den)
    long = marked.where(~short & rest)
    asking = long.where("still").select("token").distinct()
    long = written(long.join(asking, "token").select("token", "doc_id", "line", "length", "still"))
    gone = gone.union(written(more.union(_block_matches(long, line_texts, size, num, den))))
    return firsts.select("doc_id", "line").join(gone.distinct(), ["doc_id", "line"], "left_anti")


def without_similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 75,
                          den: int = 100, carried: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, text, n_lines, n_removed)`` for each row of ``docs``: the text without lines similar to an earlier one.

    Lines are what ``\\n`` separates; their words are runs of anything but ASCII white space with A-Z in lower case, their
    tokens the distinct runs of ``size`` words, or the whole line where it has fewer. Earlier is a smaller id, or the same
    document and a smaller line number. A line goes if an earlier line of the input, itself removed or not, has
    ``den * intersection >= num * union``. Lines without words always stay. A null text stays null, with no lines. Rows without
    an id stay as they are. Rows that repeat an id and text count as one document and get the same result; those of one id with
    different texts are documents of their own, in the order of the MD5 of their texts. An empty table gives no rows; other columns are ignored, or come along as the struct ``carried``. Jobs run and steps are written when
    this is called.
    """
    docs = texts(docs, id_col, text_col, carried)
    if (rows := told_apart(docs)) is not None:
        found = without_similar_lines(rows, "row", "text", size, num, den, [c for c in docs.columns if c != "text"])
        return found.select("carried.doc_id", *found.columns[1:-1], *(["carried.carried"] if carried else []))
    stay = kept_lines(docs.select("doc_id", "text"), size, num, den).groupBy("doc_id").agg(F.collect_set("line").alias("stay"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lines, removed = [], [], []
            stays = batch.column("stay").to_pylist()
            for doc, data, own in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), stays, strict=True):
                cut = data.split(b"\n") if data is not None else []
                own = set(own or ())
                kept = [x for i, x in enumerate(cut) if i in own or not x.strip()] if doc is not None else cut
                text.append(b"\n".join(kept) if data is not None else None)
                lines.append(len(cut))
                removed.append(len(cut) - len(kept))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(text, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()),
                pa.array(removed, pa.int64()), *([batch.column("carried")] if carried else [])],
                ["doc_id", "text", "n_lines", "n_removed", *(["carried"] if carried else [])])

    return docs.join(stay, "doc_id", "left").mapInArrow(
        rebuild, f"doc_id long, text string, n_lines long, n_removed long{carried_type(docs)}")
