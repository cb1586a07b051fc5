"""Reading corpus tables and cutting them into words, shingles and lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.llm.steps import written
from pricelode.plans.spread import spread

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}

#: Bytes of text whose words are hashed together, few enough for a core's cache; a longer text is taken by itself.
HASHED = 1 << 17
#: Rows of an Arrow batch at most: texts are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the corpus; one that is a single small file is spread over the cores by its id."""
    scan = spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return spread(scan, scan.columns[0])


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: Sequence[str] = ()) -> DataFrame:
    """The two columns the operators work on, as ``doc_id`` and ``text``; whatever else is there is left behind, but for the
    ``carried`` columns, which come along in one struct of that name."""
    small_batches(docs.sparkSession)
    own = [docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")]
    return docs.select(*own, *([F.struct(*(docs[c] for c in carried)).alias("carried")] if carried else []))


def told_apart(docs: DataFrame) -> DataFrame | None:
    """``docs(doc_id, text, ...)`` with a number ``row`` for each id and text, in the order of ids and, for one id, of the MD5 of
    texts; none for rows without an id. Nothing is returned where every id has one text: a scan of the ids tells where none
    repeats, else the texts of those that do are compared."""
    own, text = docs.where("doc_id IS NOT NULL"), F.coalesce("text", F.lit(""))
    repeated = own.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return None
    texts_of = own.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.xxhash64(text)).alias("a"), F.max(F.xxhash64(text)).alias("b"))
    if texts_of.where("a <> b").isEmpty():
        return None
    named = own.select("doc_id", F.md5(text.cast("binary")).alias("digest")).distinct()
    rows = written(named.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest").select(
        F.col("doc_id").alias("of"), "digest", F.monotonically_increasing_id().alias("row")))  # ranges come in order
    return docs.join(rows, (F.col("doc_id") == F.col("of")) & (F.md5(text.cast("binary")) == F.col("digest")), "left").drop("of", "digest")


def small_batches(spark: SparkSession) -> None:
    """Lets the session hand texts to Python in batches of at most ``BATCH_ROWS`` rows from now on."""
    if not 0 < int(spark.conf.get(_BATCH, "10000")) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def carried_type(docs: DataFrame) -> str:
    """What a schema string needs for the carried columns of ``docs``."""
    return f", carried {docs.schema['carried'].dataType.simpleString()}" if "carried" in docs.columns else ""


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The values of a string column as bytes, without decoding them."""
    return (v.as_py() for v in column.cast(pa.large_binary()))


def chunks(column: pa.Array, most: int = HASHED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, bounds)``: a string column as runs of rows of about ``most`` bytes, nulls empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most, "right")) - 1)
        yield row, data[bounds[row]:bounds[end]], bounds[row:end + 1] - bounds[row]
        row = end


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse."""
    one = np.ones(1, np.uint64)
    return tuple(np.concatenate([one, np.cumprod(np.full(n, x, np.uint64))]) for x in (_BASE, pow(_BASE, -1, 2**64)))


def words_in(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, places)``: a hash per word of the rows that ``bounds`` cut ``data`` into, and where each row's words start.

    Words are runs of anything but ASCII white space, none crosses rows; with ``lower`` A-Z count as a-z.
    """
    data = _LOWER[data] if lower else data
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = np.unique(bounds[1:-1])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # rows that meet without white space
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # as many words as take up HASHED bytes, or one longer one
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + HASHED, "right")))
        part = data[starts[at]:ends[to - 1]]
        powers, inverses = _powers(max(HASHED, 1 << max(0, len(part) - 1).bit_length()))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * powers[:len(part)], out=sums[1:])
        a, b = starts[at:to] - starts[at], ends[at:to] - starts[at]
        hashes[at:to] = mixed(((sums[b] - sums[a]) * inverses[a]) ^ (b - a).astype(np.uint64) * _MIX_1)
        at = to
    return hashes, np.searchsorted(starts, bounds)


def word_hashes(column: pa.Array, lower: bool = True) -> Iterator[np.ndarray]:
    """The word hashes of each row of a string column; none for a null."""
    for _, data, bounds in chunks(column):
        hashes, places = words_in(data, bounds, lower)
        for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
            yield hashes[a:b]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


#: Odd multipliers of the words of a shingle; longer shingles go on with powers of the first.
_PLACES = mixed(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)


def _place(i: int) -> np.uint64:
    return _PLACES[i] if i < len(_PLACES) else np.uint64(pow(int(_PLACES[0]), i, 2**64))


def shingle_hashes(word_hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """One hash per run of ``size`` words; fewer words are one run, none give nothing."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    width = min(size, n)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total += word_hashes[i:n - width + 1 + i] * _place(i)
    return mixed(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def set_key(sorted_hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of hashes."""
    d = np.frombuffer(xxhash.xxh3_128_digest(sorted_hashes.tobytes()), np.int64)
    return int(d[0]), int(d[1])
