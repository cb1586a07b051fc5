"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame per record."""

from __future__ import annotations

import hashlib
import posixpath
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.plans.durable import checkpointed, scratch_path

# Fixed values of the WARC 1.1, WARC-Zstandard and Zstandard formats.
VERSION = b"WARC/1.1"
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: A task starts another archive after so many compressed bytes; a record is never split.
ARCHIVE_BYTES = 64 << 20
#: The dictionary is trained on the first records of its archive, up to so many bytes, all of which are then written.
SAMPLE_BYTES, DICTIONARY_BYTES, SAMPLE_RECORD = 1 << 20, 16 << 10, 16 << 10
_URN = "urn:x-page:"
_MANIFEST = "archive string, records long, bytes long"
_RECORD = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
           "payload binary")


class BadArchive(ValueError):
    """An archive that breaks the format."""


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
            least_bytes: int = 100) -> DataFrame:
    """What record each page becomes: ``page_id, url, payload, payload_digest, refers_to``.

    Of pages with equal payloads of at least ``least_bytes`` the smallest id is stored and the others refer to it; rows
    that repeat that very id are stored too. A null body is an empty payload; a row without an id refers to an equal page
    that has one, and is stored where none has. The smallest ids are an aggregation that combines before its shuffle,
    and only payloads that occur again are joined.
    """
    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"),
        F.coalesce(pages[body_col].cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("payload_digest", F.sha2("payload", 256))
    again = (
        rows.where(F.octet_length("payload") >= least_bytes).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n"))
    return rows.join(again, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(planned_pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the records below ``folder`` and returns the manifest ``archive, records, bytes``.

    Each task writes archives of its own under names that no other attempt uses; the manifest lists those of the
    attempts that succeeded, so what a lost executor left behind is never read. Empty input gives an empty manifest.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        records = _records(batches)
        made = []
        for first in records:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(posixpath.join(base, name), compression=None) as out:
                made.append((name, *_write_one(out, first, records, archive_bytes)))
        names, counts, sizes = zip(*made, strict=True) if made else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
            ["archive", "records", "bytes"])

    return checkpointed(planned_pages.mapInArrow(write, _MANIFEST))


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the archives of ``manifest``, one archive a task and one frame at a time.

    Every record's version line, headers, lengths and payload digest are checked; a fault raises ``BadArchive``. A revisit
    has the length and digest of the full payload, and no payload of its own. ``payloads=False`` leaves payloads null.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                            ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("payload", pa.binary())])
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, count = [], 0, 0
                with fs.open_input_stream(posixpath.join(base, name), compression=None, buffer_size=1 << 20) as source:
                    for record in read_records(source):
                        row = parsed(record)
                        rows.append(row if payloads else row | {"payload": None})
                        held, count = held + len(record) * payloads, count + 1
                        if held > 8 << 20 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if count != expected:
                    raise BadArchive(f"{name} has {count} records of {expected}")
                yield pa.RecordBatch.from_pylist(rows, schema)

    spread = max(1, min(manifest.count(), 10_000))
    return manifest.select("archive", "records").repartition(spread, "archive").mapInArrow(read, _RECORD)


def archived(pages: DataFrame, folder: str | None = None, payloads: bool = True, **columns) -> DataFrame:
    """Writes ``pages`` as WARC archives and reads them back; the default folder is a new one in the shared folder."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder else f"file://{folder}"
    return read_archives(write_archives(planned(pages, **columns), folder), folder, payloads)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to")]
        for i in range(batch.num_rows):
            yield record(*(c[i].as_py() for c in columns))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP headers alone."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_URN}{'none' if page_id is None else page_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write_one(out: BinaryIO, first: bytes, more: Iterator[bytes], archive_bytes: int) -> tuple[int, int]:
    """Fills one archive; returns its records and bytes."""
    sample, held = [first], len(first)
    while held < min(SAMPLE_BYTES, archive_bytes) and (nxt := next(more, None)) is not None:
        sample.append(nxt)
        held += len(nxt)
    shared = _dictionary(sample)
    raw = shared.as_bytes() if shared else b""
    written = 0
    if raw:
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        written += 8 + len(raw)
    packer = zstd.ZstdCompressor(level=3, dict_data=shared, write_content_size=True, write_checksum=True)
    count = 0
    while sample or written < archive_bytes:
        nxt = sample.pop(0) if sample else next(more, None)
        if nxt is None:
            break
        frame = packer.compress(nxt)
        out.write(frame)
        written, count = written + len(frame), count + 1
    return count, written


def _dictionary(sample: list[bytes]) -> zstd.ZstdCompressionDict | None:
    """A dictionary trained on the starts of the sample's records; none where there is too little to learn from."""
    if len(sample) < 8:
        return None
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, [s[:SAMPLE_RECORD] for s in sample], level=3)
    except zstd.ZstdError:
        return None


def _exactly(source: BinaryIO, n: int) -> bytes:
    data = source.read(n)
    if len(data) != n:
        raise BadArchive("the archive ends inside a frame")
    return data


def read_records(source: BinaryIO) -> Iterator[bytes]:
    """The records of one archive: loads the dictionary, then decodes one frame at a time."""
    shared, leading = None, True
    unpack = zstd.ZstdDecompressor()
    while magic := source.read(4):
        if len(magic) != 4:
            raise BadArchive("the archive ends inside a frame")
        kind = int.from_bytes(magic, "little")
        if kind in SKIPPABLE:
            body = _exactly(source, int.from_bytes(_exactly(source, 4), "little"))
            if kind == DICTIONARY_FRAME:
                if not leading:
                    raise BadArchive("a dictionary after the first frame")
                if body[:4] == FRAME.to_bytes(4, "little"):  # a dictionary may itself be compressed
                    body = zstd.ZstdDecompressor().decompress(body)
                shared = zstd.ZstdCompressionDict(body)
                unpack = zstd.ZstdDecompressor(dict_data=shared)
        elif kind == FRAME:
            try:
                yield unpack.decompressobj().decompress(magic + _rest_of_frame(source))
            except zstd.ZstdError as e:
                raise BadArchive(f"a frame can't be decoded: {e}") from e
        else:
            raise BadArchive(f"no frame starts with {kind:#x}")
        leading = False


def _rest_of_frame(source: BinaryIO) -> bytes:
    """What follows the magic number: the frame header, the blocks up to the last, and the checksum."""
    parts = [_exactly(source, 1)]
    flags = parts[0][0]
    single = flags >> 5 & 1
    size = (1 if single else 0, 2, 4, 8)[flags >> 6]
    parts.append(_exactly(source, (not single) + (0, 1, 2, 4)[flags & 3] + size))
    last = False
    while not last:
        parts.append(_exactly(source, 3))
        block = int.from_bytes(parts[-1], "little")
        last = bool(block & 1)
        if (kind := block >> 1 & 3) == 3:
            raise BadArchive("a reserved block type")
        parts.append(_exactly(source, 1 if kind == 1 else block >> 3))
    if flags >> 2 & 1:
        parts.append(_exactly(source, 4))
    return b"".join(parts)


def parsed(data: bytes) -> dict:
    """A record's fields, after checks of its version, headers, lengths and digest."""
    head, end, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if version != VERSION or not end:
        raise BadArchive("a record does not start with its version and headers")
    fields = {}
    for line in lines.decode().split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            raise BadArchive(f"a bad header line: {line[:80]}")
        fields[name.lower()] = value.strip(" \t")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise BadArchive(f"a record without {name}")
    block = rest[:-4]
    if rest[-4:] != b"\r\n\r\n" or not fields["content-length"].isdigit() or int(fields["content-length"]) != len(block):
        raise BadArchive("a record's length is not what its header says")
    http, end, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if not end or not length or kind not in ("response", "revisit") or (kind == "revisit") != ("warc-refers-to" in fields):
        raise BadArchive("a record is neither a response nor a revisit")
    if kind == "response" and (int(length[1]) != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
        raise BadArchive("a payload is not what its headers say")
    url = fields.get("warc-target-uri")
    return {
        "page_id": _page(fields["warc-record-id"]), "record_type": kind,
        "url": url and re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url),
        "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None,
        "payload_bytes": int(length[1]), "payload_digest": digest, "payload": payload if kind == "response" else None}


def _page(urn: str) -> int | None:
    number = urn.removeprefix(f"<{_URN}").removesuffix(">")
    return None if number == "none" else int(number)
