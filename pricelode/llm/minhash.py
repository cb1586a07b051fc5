"""MinHash near-dedup by an inverted join over signature coordinates, links confirmed on full shingle sets.

1. Every text gets the set of its word shingles and a signature of ``COORDINATES`` minima. Texts of one and the same set
   are one class, which its smallest id stands for.
2. Classes are posted under each (coordinate, value) pair. A pair of similar texts agrees in at least ``MATCHES``
   coordinates (see there), so values that only one class has are left out, a class with fewer shared values than that has
   no partner, and of the others only the rarest ``shared - MATCHES + 1`` are indexed: the longer lists are skipped, for two
   classes with enough matches meet in a shorter one.
3. Components need not all links but enough of them. In every list each class meets the list's first class; candidates
   with enough matches are confirmed on their full sets, and the confirmed ones give components. Only classes of different
   components that share a list can still add a link; of them, those whose numbers of shingles known to any other of
   these classes rule a link out are left aside. All others are compared: in short lists pair by pair, in longer ones
   block against block on their full sets, where a task gives no more links than join its components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricelode.llm.components import components
from pricelode.llm.corpus import mixed, set_key, shingle_hashes, signed, texts, word_hashes
from pricelode.llm.steps import written

COORDINATES = 32
#: The least number of equal coordinates. At a similarity of 0.75 fewer than 10 of 32 happen once in 29 million pairs.
MATCHES = 10
_SEEDS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Longer lists are compared in blocks, of so many classes at most on average.
SHORT, BLOCK = 32, 1_024
#: Shingles of a text hashed together; what a task needs beside the text itself.
_BLOCK = 4_096


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The set of each text: sorted hashes of its runs of ``size`` words."""
    return (np.unique(shingle_hashes(w, size)) for w in word_hashes(column))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Per coordinate the upper half of the least hash over the set."""
    least = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), _BLOCK):
        part = (shingles[at:at + _BLOCK, None] ^ _SEEDS) * _SEEDS[::-1]
        part ^= part >> np.uint64(29)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, size: int = 5) -> DataFrame:
    """``(doc_id, n_shingles, k1, k2, signature)``: set size, 128 bits for the set, and its minima; null without shingles."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), size))
            keys = [set_key(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()),
                pa.array([k[1] for k in keys], pa.int64()),
                pa.array([signature(s).view(np.int32) if len(s) else None for s in sets], pa.list_(pa.int32()))],
                ["doc_id", "n_shingles", "k1", "k2", "signature"])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, k1 long, k2 long, signature array<int>")


def _indexed(reps: DataFrame) -> DataFrame:
    """``(key, cls, n)``: the lists that candidates come from, after prefix and skipping."""
    posted = reps.select("cls", "n", F.posexplode("signature").alias("at", "value")).select(
        "cls", "n", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value")).alias("key"))
    lists = posted.groupBy("key").agg(F.count("*").alias("length")).where("length > 1")
    of_class = W.partitionBy("cls")
    return (
        posted.join(lists, "key")
        .withColumns({"place": F.row_number().over(of_class.orderBy("length", "key")),
                      "shared": F.count("*").over(of_class)})
        .where(F.col("place") <= F.col("shared") - MATCHES + 1).select("key", "cls", "n"))


def _counted(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of ``pairs(a, b)`` those whose signatures agree in enough coordinates."""
    one = reps.select(F.col("cls").alias("a"), F.col("signature").alias("s"))
    two = reps.select(F.col("cls").alias("b"), F.col("signature").alias("t"))
    same = F.aggregate(F.zip_with("s", "t", lambda x, y: (x == y).cast("int")), F.lit(0), lambda c, x: c + x)
    return pairs.join(one, "a").join(two, "b").where(same >= MATCHES).select("a", "b")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Of ``pairs(a, b)`` of classes those whose full sets are similar enough."""
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(*(shingle_sets(batch.column(i), size) for i in (2, 3)), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    one = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    two = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long")


def _known(docs: DataFrame, size: int) -> DataFrame:
    """``(cls, known)``: how many shingles of each of ``docs`` another of them has too."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), size), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), doc)), pa.array(signed(s))], ["cls", "shingle"])

    rows = docs.mapInArrow(cut, "cls long, shingle long")
    again = rows.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    return rows.join(again, "shingle").groupBy("cls").agg(F.count("*").alias("known"))


def _links_within(table: pa.Table, num: int, den: int) -> pa.Table:
    """Links between the components of two blocks of one list, no more than it takes to join them.

    All intersections come from products of 0/1 matrices, a few shingles at a time; only shingles that several classes have
    take part. Classes outside the largest component are compared with all.
    """
    cls, place = np.unique(table.column("cls").to_numpy(), return_index=True)
    sets = [np.frombuffer(table.column("s")[i].as_py(), np.uint64) for i in place.tolist()]
    n = np.array([len(x) for x in sets])
    _, component, members = np.unique(table.column("component").to_numpy()[place], return_inverse=True, return_counts=True)
    asks = np.flatnonzero(component != members.argmax())
    _, shingle, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = count[shingle] > 1
    number = np.cumsum(count > 1) - 1
    column, row = number[shingle[shared]], row[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    common = np.zeros((len(asks), len(cls)), np.float32)
    for at in range(0, int(number[-1]) + 1, _BLOCK):
        a, b = np.searchsorted(column, (at, at + _BLOCK))
        has = np.zeros((len(cls), _BLOCK), np.float32)
        has[row[a:b], column[a:b] - at] = 1
        common += has[asks] @ has.T
    common = common.astype(np.int64)
    linked = den * common >= num * (n[asks][:, None] + n[None, :] - common)
    linked &= component[asks][:, None] != component[None, :]
    root = list(range(len(members)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = find(int(component[asks[i]])), find(int(component[j]))
        if a != b:
            root[a] = b
            out.append((int(cls[asks[i]]), int(cls[j])))
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _block_links(lists: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links between components within long lists ``(key, cls, component, members)``."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["cls", "s"])

    wanted = lists.select(F.col("cls").alias("doc_id")).distinct()
    of_class = docs.join(wanted, "doc_id", "left_semi").mapInArrow(sets, "cls long, s binary")
    blocks = F.ceil(F.col("members") / BLOCK)
    dealt = lists.withColumn("own", F.pmod(F.xxhash64("cls"), blocks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return (
        dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "component")
        .join(of_class, "cls").groupBy("key", "i", "j")
        .applyInArrow(lambda table: _links_within(table, num, den), "a long, b long"))


def _several_sets(signed_docs: DataFrame) -> DataFrame:
    """Ids whose rows have different sets."""
    same = "least_1 <=> most_1 AND least_2 <=> most_2 AND with_words IN (0, n)"
    return signed_docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("k1").alias("least_1"), F.max("k1").alias("most_1"), F.min("k2").alias("least_2"), F.max("k2").alias("most_2"),
        F.count("k1").alias("with_words"), F.count("*").alias("n")).where(f"NOT ({same})")


def _by_row(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Near duplicates where an id has different texts: of rows under numbers of their own, then of the ids they have."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), "text"))
    found = near_duplicates(rows, "row", "text", size, num, den).select(
        F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("of_rows"))
    placed = written(rows.select("row", "id").join(found, "row"))
    with_id = placed.where("id IS NOT NULL")
    least = with_id.groupBy("of_rows").agg(F.min("id").alias("b"))
    joined = components(with_id.join(least, "of_rows").select(F.col("id").alias("a"), "b"))
    return placed.join(joined.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 75,
                    den: int = 100) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``.

    Words are runs of anything but ASCII white space with A-Z in lower case; a text's set are its distinct runs of ``size``
    words, or the whole text where it has fewer. Texts are linked where ``den * intersection >= num * union``;
    ``component_id`` is the smallest id that links reach, ``kept`` says that it is the text's own. Null and empty texts have
    an empty set and are linked with nothing. Rows that repeat an id are linked to each other by it, also if their texts differ:
    the links of each of its texts are links of the id, and all its rows have one component.
    Rows without an id take no part: their component is null, and they are kept. An empty table gives no rows; other
    columns are ignored. Jobs run and steps are written when this is called.
    """
    docs = texts(docs, id_col, text_col)
    signed_docs = written(signatures(docs, size))
    if not _several_sets(signed_docs).isEmpty():
        return _by_row(docs, size, num, den)
    with_id = signed_docs.where("doc_id IS NOT NULL AND k1 IS NOT NULL")
    classes = written(with_id.groupBy("k1", "k2").agg(F.min("doc_id").alias("cls")))
    reps = written(
        with_id.join(classes, ["k1", "k2"]).where("doc_id = cls")
        .select("cls", F.col("n_shingles").alias("n"), "signature").dropDuplicates(["cls"]))
    lists = written(_indexed(reps))
    listed = lists.select(F.col("cls").alias("doc_id")).distinct()
    own_texts = written(docs.join(listed, "doc_id", "left_semi").dropDuplicates(["doc_id"]))

    fits = F.expr(f"{den} * least(n, m) >= {num} * greatest(n, m)")
    heads = lists.groupBy("key").agg(F.min("cls").alias("a"))
    first = (
        lists.join(heads, "key").where("cls > a").select("a", F.col("cls").alias("b"), "n").distinct()
        .join(reps.select(F.col("cls").alias("a"), F.col("n").alias("m")), "a").where(fits).select("a", "b"))
    links = written(_confirmed(_counted(first, reps), own_texts, size, num, den))
    found = components(links)

    # What the lists can still link: classes of different components.
    placed = lists.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls"))
    mixed_lists = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    open_lists = written(placed.join(mixed_lists.select("key"), "key"))
    open_classes = open_lists.select(F.col("cls").alias("doc_id")).distinct()
    known = _known(own_texts.join(open_classes, "doc_id", "left_semi"), size)
    able = written(open_lists.join(known, "cls").where(f"{den} * known >= {num} * n"))
    still = able.groupBy("key").agg(
        F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    able = written(able.join(still.select("key", "members"), "key"))
    short = able.where(F.col("members") <= SHORT)
    x, y = short.alias("x"), short.alias("y")
    common = "least(x.known, y.known)"
    rest = (
        x.join(y, "key")
        .where(f"x.cls < y.cls AND x.component <> y.component AND {den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n) "
               f"AND {den} * {common} >= {num} * (x.n + y.n - {common})")
        .select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct())
    more = written(
        _confirmed(_counted(rest, reps), own_texts, size, num, den)
        .union(_block_links(able.where(F.col("members") > SHORT), own_texts, size, num, den)))
    if not more.isEmpty():
        found = components(links.union(more))
    members = classes.join(found.withColumnRenamed("node", "cls"), "cls", "left").select(
        "k1", "k2", F.coalesce("component", "cls").alias("component_id"))
    return signed_docs.join(members, ["k1", "k2"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
