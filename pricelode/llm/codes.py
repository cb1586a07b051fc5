"""Vectors as short codes: one codebook per part of the vector, nearest entries through memoised grid cells.

A part falls into a coarse cell of an integer grid. For each cell that a task meets it remembers which entries can be nearest to
any point of that cell's box: an entry is out if its least distance to the box is more than another one's greatest. Only what is
left is compared exactly with the points of the cell.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.llm.steps import written

#: Cells a task remembers per part; further ones are worked out whenever they are met.
REMEMBERED = 1 << 15
_LONGEST = 2**63 - 1
_LIMB = 32


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor numbers that are not finite."""
    infinite = F.lit(float("inf"))
    finite = (F.size(vector) == 0) | ((F.array_max(vector) < infinite) & (F.array_min(vector) > -infinite))  # NaN is greatest
    return F.coalesce(vector.isNotNull() & (F.size(F.array_compact(vector)) == F.size(vector)) & finite, F.lit(False))


class Grid:
    """The codebook of one part, with the entries that are left in each cell met so far.

    A cell's side is a power of two of about an eighth of the entries' usual distance to their nearest neighbour per dimension.
    """

    def __init__(self, book: np.ndarray, remembered: int = REMEMBERED):
        self.book, self.remembered = book, remembered
        self.known: dict[object, bytes] = {}
        gaps = ((book[:, None] - book[None]) ** 2).sum(axis=2)
        nearest = sorted(min((d for j, d in enumerate(row) if j != i), default=0) for i, row in enumerate(gaps.tolist()))
        side = math.isqrt(nearest[len(nearest) // 2] // max(1, book.shape[1])) // 2
        self.shift = max(0, side.bit_length() - 1)

    def left(self, cells: np.ndarray) -> np.ndarray:
        """``(cells, entries)``: the entries that are not dominated across each cell's box."""
        low = (cells << self.shift)[:, None]
        below, above = low - self.book[None], self.book[None] - (low + ((1 << self.shift) - 1))
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
        most = (np.maximum(abs(below), abs(above)) ** 2).sum(axis=2)
        return (least <= most.min(axis=1)[:, None]).astype(bool)

    def masks(self, points: np.ndarray) -> np.ndarray:
        cells = points >> self.shift
        if cells.dtype == object:
            keys = [tuple(c) for c in cells.tolist()]
            place = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            back, keys = np.array([place[k] for k in keys]), list(place)
            cells = np.array([list(k) for k in keys], object).reshape(len(keys), -1)
        else:
            raw = np.ascontiguousarray(cells).view(np.dtype((np.void, cells.shape[1] * cells.itemsize))).ravel()
            different, back = np.unique(raw, return_inverse=True)
            cells, keys = different.view(np.int64).reshape(len(different), -1), different.tolist()
        packed = [self.known.get(k) for k in keys]
        new = [i for i, p in enumerate(packed) if p is None]
        if new:
            for i, row in zip(new, np.packbits(self.left(cells[new]), axis=1), strict=True):
                packed[i] = row.tobytes()
                if len(self.known) < self.remembered:
                    self.known[keys[i]] = packed[i]
        bits = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        return np.unpackbits(bits, axis=1, count=len(self.book)).astype(bool)[back]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each point, the lower one of equally near ones, and the squared distance."""
        row, entry = np.nonzero(self.masks(points))
        ranked = ((points[row] - self.book[entry]) ** 2).sum(axis=1) * len(self.book) + entry
        best = np.minimum.reduceat(ranked, np.searchsorted(row, np.arange(len(points))))
        return (best % len(self.book)).astype(np.int64), best // len(self.book)


class Codebooks:
    """Codebooks of all parts: whole numbers, ``(parts, entries, width of a part)``."""

    def __init__(self, books: np.ndarray, scale: int, exact: bool):
        self.books, self.scale, self.exact = books, scale, exact  # exact: numbers that 64 bits can't hold

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def parts_of(self, column: pa.Array) -> np.ndarray:
        """``(rows, parts, width)``: vectors in whole numbers, filled up with zeros."""
        parts, _, width = self.books.shape
        lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        x = np.floor(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * self.scale)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out = np.zeros((len(lengths), parts * width), object if self.exact else np.int64)
        out[owner, place] = [int(v) for v in x.tolist()] if self.exact else x.astype(np.int64)
        return out.reshape(len(lengths), parts, width)

    def grids(self) -> list[Grid]:
        return [Grid(b) for b in self.books]


def _columns(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    label = F.lit(None).cast("int") if label_col is None else vectors[label_col]
    return vectors.where(usable(vectors[vector_col])).select(
        vectors[id_col].alias("vec_id"), label.alias("label"), vectors[vector_col].alias("vector"))


def trained(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 16, entries: int = 64,
            rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """Codebooks over all usable rows; none if there are no such rows.

    They start with the rows of the ``entries`` smallest ids (rows of one id by their components, rows without an id last).
    Each round is one pass that brings ``parts * entries`` sums to the driver, whatever the size of the table.
    """
    kept = _columns(vectors, id_col, vector_col, None)
    longest, largest = kept.agg(F.max(F.size("vector")), F.max(F.greatest(
        F.array_max("vector"), -F.array_min("vector")).cast("double"))).first()
    if longest is None:
        return None
    width = max(1, -(-longest // parts))
    reach = int(math.ceil((largest or 0.0))) * scale + scale
    exact = width * (2 * reach) ** 2 * entries >= 2**62
    limbs = 1 if not exact else -(-(reach.bit_length() + 1) // _LIMB)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()
    start = pa.array([r[0] for r in first], pa.list_(pa.float64()))
    books = Codebooks(np.zeros((parts, len(first), width), np.int64), scale, exact)
    books.books = books.parts_of(start).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = Codebooks(_moved(kept, books, limbs), scale, exact)
    return books


def _moved(kept: DataFrame, books: Codebooks, limbs: int) -> np.ndarray:
    """Each entry in the middle of the parts that are nearest to it, rounded down."""
    parts, entries, width = books.books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = books.grids()
        sums = np.zeros((parts, entries, width), object if books.exact else np.int64)
        count = np.zeros((parts, entries), np.int64)
        for batch in batches:
            points = books.parts_of(batch.column(0))
            for p, grid in enumerate(grids):
                if len(points):
                    index, _ = grid.nearest(points[:, p])
                    np.add.at(sums[p], index, points[:, p])
                    count[p] += np.bincount(index, minlength=entries)
        part, entry = np.nonzero(count)
        rows = [_limbs(s, limbs) for s in sums[part, entry].tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry], pa.int64()),
             pa.array(rows, pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    found = kept.select("vector").mapInArrow(add, "part int, entry int, n long, sums array<long>").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(width * limbs))).alias("sums")).collect()
    out = books.books.copy()
    for r in found:  # parts * entries rows at most
        for i in range(width):
            total = sum(limb << (_LIMB * j) for j, limb in enumerate(r["sums"][i * limbs:(i + 1) * limbs]))
            out[r["part"], r["entry"], i] = total // r["n"]
    return out


def _limbs(values: list[int], limbs: int) -> list[int]:
    """Numbers as digits of 32 bits that can be summed one by one; the last digit carries the sign."""
    digit = (1 << _LIMB) - 1
    return [(v >> (_LIMB * j)) & digit if j < limbs - 1 else v >> (_LIMB * j) for v in values for j in range(limbs)]


def coded(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding",
          label_col: str | None = "label") -> DataFrame:
    """``(vec_id, label, code, error)`` per usable row: the entries' indexes, two hex digits each, and the squared distance."""
    kept = _columns(vectors, id_col, vector_col, label_col)
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = books.grids()
        for batch in batches:
            points = books.parts_of(batch.column(2))
            index, error = np.zeros(points.shape[:2], np.uint8), np.zeros(len(points), points.dtype)
            for p, grid in enumerate(grids):
                if len(points):
                    found, distance = grid.nearest(points[:, p])
                    index[:, p] = found
                    error = error + distance
            digits, n = index.tobytes().hex(), 2 * len(grids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([digits[i:i + n] for i in range(0, len(digits), n)], pa.string()),
                 pa.array([min(int(e), _LONGEST) for e in error.tolist()], pa.int64())], ["vec_id", "label", "code", "error"])

    return kept.mapInArrow(encode, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")


def decoded(codes: DataFrame, books: Codebooks, id_col: str = "vec_id", code_col: str = "code") -> DataFrame:
    """``(vec_id, vector)``: the vectors that the codes stand for."""
    flat = F.lit((books.books / books.scale).astype(float).reshape(-1, books.books.shape[2]).tolist()).cast("array<array<double>>")
    parts, entries = books.books.shape[:2]
    at = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.element_at(
        flat, p * entries + F.conv(F.substr(F.col(code_col), 2 * p + 1, F.lit(2)), 16, 10).cast("int") + 1))
    return codes.select(F.col(id_col).alias("vec_id"), F.flatten(at).alias("vector"))


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
               parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` for each usable row, errors also summed over equal labels.

    Rows whose vector is null or holds a null or a number that is not finite are dropped. Rows without an id and rows that
    repeat are coded like any other and count in the codebooks. Rows without a label are one group. Vectors of different
    lengths are filled up with zeros to the longest, and to a multiple of ``parts``. A sum beyond 64 bits is shown as the
    largest 64-bit number. An empty table gives no rows; other columns are ignored. Four passes over the vectors, and no
    shuffle but of the sums: errors are summed by label before they are joined back, so that a frequent label costs no more.
    """
    books = trained(vectors, id_col, vector_col, parts, entries, rounds, scale)
    if books is None:
        return vectors.select(
            vectors[id_col].alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
            F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).where(F.lit(False))
    codes = written(coded(vectors, books, id_col, vector_col, label_col))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONGEST).cast("decimal(38,0)")).cast("long")
    sums = written(codes.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")))  # its size tells how to join it
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
