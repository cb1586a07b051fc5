"""Suffix-array dedup: removes every byte that a string of ``length`` bytes covers which also starts earlier.

Suffixes are ordered by their leading tokens, which are hashes of the bytes they start with. Two rounds sort them:

1. *Sampled suffixes.* The strings of ``length`` bytes that share their smallest gram (the ``gram``-byte piece of least
   hash, the leftmost of equal ones) form a run of neighbouring starts, about one run per 25 bytes. A run's leading token
   is that gram, its second token covers all bytes of the run. Where a gram occurs once, no string of its runs occurs
   twice. Where a whole run occurs earlier, so does each of its strings. Both need no further look.
2. *Remaining suffixes.* Runs whose gram occurs with other bytes around it give every string by itself, led by two tokens
   of half the length each.

In both, splitters sampled from the suffixes cut the order into buckets of bounded size (the order ends with document and
place, so that equal suffixes are split as well), buckets are sorted by multikey quicksort, and a bucket's first suffixes
are compared with the last of the bucket before it. Suffixes travel as packed columns, one row per task and bucket.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pricelode.llm.corpus import carried_type, mixed, texts, told_apart, utf8
from pricelode.llm.steps import written

#: Suffixes that one bucket holds on average, whatever the size of the corpus: what bounds a task's memory.
BUCKET = 1_000_000
#: Suffixes sampled per bucket for the splitters.
SAMPLED = 32
#: Text that a task cuts into suffixes before it hands them on.
BUFFERED = 16 << 20
GRAM = 48
_BASE = 0x9E3779B97F4A7C15
_STEP = 1 << 16
_POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(_STEP, _BASE, np.uint64))])
_INVERSES = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(_STEP, pow(_BASE, -1, 2**64), np.uint64))])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse; kept up to the longest text so far."""
    global _POWERS, _INVERSES
    while len(_POWERS) < n:
        _POWERS = np.concatenate([_POWERS, _POWERS[1:] * _POWERS[-1]])
        _INVERSES = np.concatenate([_INVERSES, _INVERSES[1:] * _INVERSES[-1]])
    return _POWERS, _INVERSES


class Prefixes:
    """Hashes of any piece of a text from one pass over it."""

    def __init__(self, data: bytes):
        n = len(data)
        powers, self.inverses = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(data, np.uint8) + np.uint64(1)) * powers[:n], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """The hash of each piece of ``length`` bytes."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.inverses[:n])

    def pieces(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed(((self.sums[ends] - self.sums[starts]) * self.inverses[starts]) ^ mixed((ends - starts).astype(np.uint64)))


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of the least, the leftmost of equal ones."""
    place = np.arange(len(values), dtype=np.int32)
    done = 1
    while done < width:
        by = min(done, width - done)
        right = values[by:] < values[:-by]
        place = np.where(right, place[by:], place[:-by])
        values = np.minimum(values[by:], values[:-by])
        done += by
    return place


def runs(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(gram token, run token, first start, strings)`` of the runs of one text; none if it is shorter than a string."""
    if len(data) < length:
        none = np.empty(0, np.uint64)
        return none, none, np.empty(0, np.int32), np.empty(0, np.uint8)
    hashes = Prefixes(data)
    grams = hashes.every(gram)
    place = smallest(grams, length - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])).astype(np.int32)
    count = np.diff(np.append(first, len(place)))
    return (grams[place[first]], hashes.pieces(first, first + count + length - 1), first, count.astype(np.uint8))


def multikey_order(*keys: np.ndarray) -> np.ndarray:
    """The order of suffixes given by their tokens: sorts by the first and goes on to the next only where it is equal."""
    order = np.argsort(keys[0], kind="stable")
    tied = np.arange(len(order))
    group = np.zeros(len(order), np.int64)
    for done, key in zip(keys, keys[1:], strict=False):
        if not len(tied):
            break
        values = done[order[tied]]
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (group[1:] != group[:-1])])
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        tied, group = tied[several], group[several]
        order[tied] = order[tied][np.lexsort((key[order[tied]], group))]
    return order


def pack(values: np.ndarray) -> bytes:
    """Numbers as bytes, most significant planes apart, which compress well where the numbers are small or alike."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def dealt(splitters: tuple[np.ndarray, ...], keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """The bucket of each suffix: how many splitters are not after it. Only those that tie with one look past the first key."""
    first = splitters[0]
    start = np.searchsorted(first, keys[0], "left")
    bucket = start.copy()
    upto = np.searchsorted(first, keys[0], "right")
    tied = np.flatnonzero(upto > start)
    for run in np.unique(start[tied]):
        own = tied[start[tied] == run]
        for s in range(run, upto[own[0]]):
            after, same = np.zeros(len(own), bool), np.ones(len(own), bool)
            for split, key in zip(splitters[1:], keys[1:], strict=True):
                after |= same & (key[own] > split[s])
                same &= key[own] == split[s]
            bucket[own] += after | same
    return bucket


def _cuts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys start and end."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return starts, np.append(starts[1:], len(keys))


def _blobs(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row per bucket with its suffixes, every column packed; documents as steps from one to the next."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts, ends = _cuts(bucket)
    fields = [pa.array(bucket[starts], pa.int64())]
    for c in columns:
        c = c[order]
        fields.append(pa.array([pack(np.diff(c[a:b], prepend=0) if c.dtype == np.int64 else c[a:b])
                                for a, b in zip(starts, ends, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(fields, ["bucket", *"abcde"[:len(columns)]])


def _columns(table: pa.Table, kinds: list[type]) -> list[np.ndarray]:
    out = []
    for name, kind in zip("abcde", kinds, strict=False):
        parts = [unpack(v.as_py(), kind) for v in table.column(name)]
        out.append(np.concatenate([np.cumsum(p) if kind is np.int64 else p for p in parts]) if parts else np.empty(0, kind))
    return out


def _blob_schema(n: int) -> str:
    return ", ".join(["bucket long", *(f"{c} binary" for c in "abcde"[:n])])


_RUN = [np.uint64, np.uint64, np.int64, np.int32, np.uint8]
_STRING = [np.uint64, np.uint32, np.int64, np.int32]


def _half_tokens(hashes: Prefixes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    half = length // 2
    a, b = hashes.pieces(starts, starts + half), hashes.pieces(starts + half, starts + length)
    return mixed(a + b), (mixed(a ^ (b << np.uint64(1))) >> np.uint64(32)).astype(np.uint32)


def _sampled(docs: DataFrame, length: int, gram: int) -> tuple[int, dict[int, tuple[np.ndarray, ...]]]:
    """How many buckets the corpus needs, and splitters for the runs (0) and the strings (1).

    Lengths of all texts give the number of buckets. The splitters come from a sample of documents, and of their suffixes
    as many as ``SAMPLED`` per bucket; they only decide how even the buckets are.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // (BUCKET * (length - gram + 1) // 2)))
    some = max(1, min(64, size >> 24))
    per = max(1, size // some // (buckets * SAMPLED))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, data in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if data is None or len(data) < length:
                    continue
                g, c, first, count = runs(data, length, gram)
                kept = np.flatnonzero(mixed(g + c + np.uint64(doc & 2**63 - 1)) % np.uint64(max(1, 2 * per // (length - gram + 1))) == 0)
                rows += [(0, int(g[i]), int(c[i]), doc, int(first[i])) for i in kept]
                at = np.flatnonzero(mixed(np.arange(len(data) - length + 1, dtype=np.uint64) + mixed(np.full(1, doc & 2**63 - 1, np.uint64)))
                                    % np.uint64(per) == 0)
                if len(at):
                    s, t = _half_tokens(Prefixes(data), at, length)
                    rows += [(1, int(s[i]), int(t[i]), doc, int(at[i])) for i in range(len(at))]
            kind, x, y, d, p = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([
                pa.array(kind, pa.int32()), pa.array(np.array(x, np.uint64).view(np.int64)),
                pa.array(np.array(y, np.uint64).view(np.int64)), pa.array(d, pa.int64()), pa.array(p, pa.int32())],
                ["kind", "x", "y", "doc", "place"])

    part = docs.where("doc_id IS NOT NULL").where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(some)) == 0)
    found = part.mapInArrow(sample, "kind int, x long, y long, doc long, place int").toPandas()
    out = {}
    for kind, second in ((0, np.uint64), (1, np.uint32)):
        own = found[found["kind"] == kind]
        keys = (own["x"].to_numpy(np.int64).view(np.uint64), own["y"].to_numpy(np.int64).view(np.uint64).astype(second),
                own["doc"].to_numpy(np.int64), own["place"].to_numpy(np.int32))
        order = multikey_order(*keys)
        out[kind] = tuple(k[order] for k in keys)
    return buckets, out


def _splitters(sample: tuple[np.ndarray, ...], buckets: int) -> tuple[np.ndarray, ...]:
    n = len(sample[0])
    at = np.unique(np.arange(1, buckets) * n // buckets) if n else np.empty(0, int)
    return tuple(k[at] for k in sample)


def _marked(docs: DataFrame, length: int, gram: int, buckets: int, sample: tuple[np.ndarray, ...]) -> DataFrame:
    """``(doc_id, m_start, m_count, m_open, opened)``: per document its runs that occur earlier, and those still open.

    The binary columns hold first starts, numbers of strings and whether the run is open; ``opened`` counts open strings.
    """
    splitters = _splitters(sample, buckets)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if data is None or len(data) < length:
                    continue
                g, c, first, count = runs(data, length, gram)
                held.append((g, c, np.full(len(g), doc, np.int64), first, count))
                size += len(data)
                if size >= BUFFERED:
                    yield from given(held)
                    held, size = [], 0
        yield from given(held)

    def given(held: list) -> Iterator[pa.RecordBatch]:
        if held:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            yield _blobs(dealt(splitters, tuple(columns[:4])), columns)

    def compare(table: pa.Table) -> pa.Table:
        g, c, doc, first, count = _columns(table, _RUN)
        order = multikey_order(g, c, doc, first)
        g, c, doc, first, count = (x[order] for x in (g, c, doc, first, count))
        new_g = np.concatenate([[True], g[1:] != g[:-1]])
        new_c = new_g | np.concatenate([[True], c[1:] != c[:-1]])
        lead = np.maximum.accumulate(np.where(new_c, np.arange(len(g)), 0))
        again = (doc != doc[lead]) | (first != first[lead])
        group = np.cumsum(new_g) - 1
        several = np.bincount(group, weights=new_c)[group] > 1
        if buckets > 1:  # the neighbouring bucket may hold more of the first and of the last gram
            several |= (group == 0) | (group == group[-1])
        kept = again | several
        homes = (mixed(doc[kept].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        by_doc = np.lexsort((first[kept], doc[kept]))
        fields = [doc[kept], first[kept], count[kept], (~again[kept]).astype(np.uint8)]
        return pa.Table.from_batches([_blobs(homes[by_doc], [f[by_doc] for f in fields])])

    def gather(table: pa.Table) -> pa.Table:
        doc, first, count, still = _columns(table, [np.int64, np.int32, np.uint8, np.uint8])
        order = np.lexsort((first, doc))
        doc, first, count, still = (x[order] for x in (doc, first, count, still))
        starts, ends = _cuts(doc)
        cuts = list(zip(starts, ends, strict=True))
        return pa.table([
            pa.array(doc[starts]), *(pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (first, count, still)),
            pa.array([int(count[a:b][still[a:b] == 1].sum()) for a, b in cuts], pa.int64())],
            ["doc_id", "m_start", "m_count", "m_open", "opened"])

    suffixes = docs.where("doc_id IS NOT NULL").mapInArrow(cut, _blob_schema(5))
    found = suffixes.groupBy("bucket").applyInArrow(compare, _blob_schema(4))
    per_doc = "doc_id long, m_start binary, m_count binary, m_open binary, opened long"
    return found.groupBy("bucket").applyInArrow(gather, per_doc)


def _repeated_strings(open_docs: DataFrame, strings: int, sample: tuple[np.ndarray, ...], length: int) -> DataFrame:
    """``(doc_id, again)``: the starts, packed, of open strings that occur earlier."""
    buckets = max(1, -(-strings // BUCKET))
    splitters = _splitters(sample, buckets)
    shape = ("home long, a binary, b binary, bucket long, first_a long, first_b long, last_a long, last_b long, "
             "lead_doc long, lead_at long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), utf8(batch.column(1)), *(batch.column(i).to_pylist() for i in (2, 3, 4)),
                       strict=True)
            for doc, data, first, count, still in rows:
                first, count, still = np.frombuffer(first, np.int32), np.frombuffer(count, np.uint8), np.frombuffer(still, np.uint8)
                first, count = first[still == 1], count[still == 1].astype(np.int64)
                at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                a, b = _half_tokens(Prefixes(data), at, length)
                held.append((a, b, np.full(len(at), doc, np.int64), at.astype(np.int32)))
                size += len(at)
                if size >= BUFFERED // 32:
                    yield from given(held)
                    held, size = [], 0
        yield from given(held)

    def given(held: list) -> Iterator[pa.RecordBatch]:
        if held:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            yield _blobs(dealt(splitters, tuple(columns)), columns)

    def compare(table: pa.Table) -> pa.Table:
        a, b, doc, at = _columns(table, _STRING)
        order = multikey_order(a, b, doc, at)
        a, b, doc, at = (x[order] for x in (a, b, doc, at))
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
        again = (doc != doc[lead]) | (at != at[lead])
        homes = (mixed(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        by_doc = np.flatnonzero(again)[np.lexsort((at[again], doc[again]))]
        rows = pa.Table.from_batches([_blobs(homes[by_doc], [doc[by_doc], at[by_doc]])])
        none = pa.nulls(rows.num_rows, pa.int64())
        rows = pa.table([*rows.columns, *[none] * 7], [f.split()[0] for f in shape.split(", ")])
        ends = (a[0].astype(np.int64), int(b[0]), a[-1].astype(np.int64), int(b[-1]), int(doc[0]), int(at[0]))
        own = pa.table([pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.binary())] * 2, table.column("bucket")[:1].combine_chunks(),
                        *(pa.array([int(e)], pa.int64()) for e in ends)], rows.column_names)
        return pa.concat_tables([rows, own])

    def gather(table: pa.Table) -> pa.Table:
        doc, at = _columns(table, [np.int64, np.int32])
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        starts, ends = _cuts(doc)
        packed = pa.array([at[x:y].tobytes() for x, y in zip(starts, ends, strict=True)], pa.binary())
        return pa.table([pa.array(doc[starts]), packed], ["doc_id", "again"])

    sorted_buckets = written(open_docs.mapInArrow(cut, _blob_schema(4)).groupBy("bucket").applyInArrow(compare, shape))
    inside = sorted_buckets.where("home IS NOT NULL").selectExpr("home AS bucket", "a", "b")
    inside = inside.groupBy("bucket").applyInArrow(gather, "doc_id long, again binary")
    before = W.orderBy("bucket")  # one row a bucket
    across = (
        sorted_buckets.where("home IS NULL")
        .withColumns({"before_a": F.lag("last_a").over(before), "before_b": F.lag("last_b").over(before)})
        .where("first_a = before_a AND first_b = before_b").select(F.col("lead_doc").alias("doc_id"), F.col("lead_at").cast("int").alias("at")))

    def pack_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([np.array([x], np.int32).tobytes() for x in batch.column(1).to_pylist()], pa.binary())],
                ["doc_id", "again"])

    return written(inside.union(across.mapInArrow(pack_one, "doc_id long, again binary")))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100,
                    gram: int = GRAM, carried: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, spans, kept)`` for each row of ``docs``.

    Texts are UTF-8 bytes, a null text is empty. A byte goes if a string of ``length`` bytes covers it that also starts
    earlier: in a document of smaller id, or earlier in the same one. Strings are judged on the input, and none crosses
    documents. ``kept`` are the remaining bytes, ``spans`` the removed ones as ``[start, end)`` pairs. Rows that repeat an id
    and its text count as one document, each gets its result; those of one id with different texts are documents of their own, in
    the order of the MD5 of their texts. Rows without an id take no part and are kept whole. Texts
    shorter than ``length`` are kept. An empty table gives no rows; other columns are ignored, or come along as the struct
    ``carried``. Jobs run and steps are written when this is called.
    """
    if not 0 < gram <= length or length - gram > 250:
        raise ValueError("gram must be at most length, and at most 250 shorter")
    docs = texts(docs, id_col, text_col, carried)
    if (rows := told_apart(docs)) is not None:
        found = without_repeats(rows, "row", "text", length, gram, [c for c in docs.columns if c != "text"])
        return found.select("carried.doc_id", *found.columns[1:-1], *(["carried.carried"] if carried else []))
    own = docs.select("doc_id", "text")
    buckets, sample = _sampled(own, length, gram)
    marks = written(_marked(own, length, gram, buckets, sample[0]))
    strings = marks.agg(F.sum("opened")).first()[0] or 0
    joined = written(docs.join(marks, "doc_id", "left"))
    if strings:
        open_docs = joined.where("opened > 0").select("doc_id", "text", "m_start", "m_count", "m_open")
        found = _repeated_strings(open_docs, strings, sample[1], length)
        again = found.groupBy("doc_id").agg(F.collect_list("again").alias("again"))
    else:
        again = docs.sparkSession.createDataFrame([], "doc_id long, again array<binary>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), utf8(batch.column(1)), *(batch.column(i).to_pylist() for i in range(2, 6)),
                       strict=True)
            out = [_without(doc, data or b"", first, count, still, more, length) for doc, data, first, count, still, more in rows]
            out = pa.RecordBatch.from_pylist(out, _RESULT)
            yield out.append_column("carried", batch.column("carried")) if carried else out

    rows = joined.join(again, "doc_id", "left").select(
        "doc_id", "text", "m_start", "m_count", "m_open", "again", *(["carried"] if carried else []))
    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<int>>, "
                                f"kept binary{carried_type(docs)}")


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                     ("spans", pa.list_(pa.list_(pa.int32()))), ("kept", pa.binary())])


def _without(doc: int | None, data: bytes, first: bytes | None, count: bytes | None, still: bytes | None,
             more: list[bytes] | None, length: int) -> dict:
    starts, ends = [], []
    if first is not None:
        closed = np.frombuffer(still, np.uint8) == 0
        starts.append(np.frombuffer(first, np.int32)[closed])
        ends.append(starts[-1] + np.frombuffer(count, np.uint8)[closed].astype(np.int32) + (length - 1))
    for at in more or ():
        starts.append(np.frombuffer(at, np.int32))
        ends.append(starts[-1] + length)
    spans = union(np.concatenate(starts), np.concatenate(ends)) if starts else np.empty((0, 2), np.int32)
    kept, at = [], 0
    for a, b in spans.tolist():
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    kept = b"".join(kept)
    return {"doc_id": doc, "n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": len(spans), "spans": spans.tolist(),
            "kept": kept}


def union(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Intervals ``[start, end)`` as their maximal runs; intervals that touch are one."""
    if not len(starts):
        return np.empty((0, 2), np.int32)
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return np.stack([starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]], axis=1)


def valid(data: bytes) -> str:
    """The bytes as text, without what is left of characters that were cut."""
    return data.decode("utf-8", "ignore")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

