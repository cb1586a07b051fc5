from __future__ import annotations

import hashlib
import io
import random

import pytest
import zstandard

from pricelode.llm import warc


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string").repartition(2)
    return make


def brute(rows):
    out = []
    for page, url, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        first = min(same, default=None) if len(body) >= 100 else page
        to = first if first is not None and first != page else None
        out.append((page, url, len(body), hashlib.sha256(body).hexdigest(), "response" if to is None else "revisit", to,
                    body if to is None else None))
    return sorted(out, key=str)


def found(frame, **kw):
    rows = warc.archived(frame, **kw).collect()
    return sorted(((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
                    None if r["payload"] is None else bytes(r["payload"])) for r in rows), key=str)


def corpus():
    r = random.Random(0)
    rows = [(i, f"http://h{i % 3}/p {i}%41\r\nX: y", "".join(r.choice("ab<p>é\r\n\0") for _ in range(r.randint(0, 400)))) for i in range(60)]
    rows += [(100 + i, None, rows[i % 5][2] * 3) for i in range(25)]
    rows += [(200, "", None), (201, "u", ""), (None, "u", rows[3][2] * 3), (None, "u", "lonely " * 40), (7, "u", "b" * 99), (8, "u", "b" * 99),
             (300, "u", "long " * 100_000)]
    return rows


def test_round_trip(pages):
    rows = corpus()
    assert found(pages(rows)) == brute(rows)


def test_many_small_archives(pages, monkeypatch, tmp_path):
    rows = corpus()
    got = warc.write_archives(warc.planned(pages(rows)), f"file://{tmp_path}", archive_bytes=3000)
    assert got.count() > 3 and got.agg({"records": "sum"}).first()[0] == len(rows)
    assert warc.read_archives(got, f"file://{tmp_path}", payloads=False).count() == len(rows)


def test_empty_table(pages):
    assert found(pages([])) == []


def archive():
    out = io.BytesIO()
    records = [warc.record(i, "u", b"some text that records share %d" % i * 20, hashlib.sha256(b"some text that records share %d" % i * 20).hexdigest(), None)
               for i in range(40)]
    warc._write_one(out, records[0], iter(records[1:]), 1 << 30)
    return out.getvalue(), records


def test_one_frame_per_record_after_the_dictionary():
    data, records = archive()
    assert data[:4] == warc.DICTIONARY_FRAME.to_bytes(4, "little")
    assert list(warc.read_records(io.BytesIO(data))) == records


def test_compressed_dictionary():
    data, records = archive()
    size = int.from_bytes(data[4:8], "little")
    packed = zstandard.ZstdCompressor().compress(data[8:8 + size])
    assert list(warc.read_records(io.BytesIO(data[:4] + len(packed).to_bytes(4, "little") + packed + data[8 + size:]))) == records


@pytest.mark.parametrize("harm", [lambda d: d[:-3], lambda d: d[:-20] + bytes([d[-20] ^ 1]) + d[-19:], lambda d: d + b"junk", lambda d: d + b"x"])
def test_broken_archives(harm):
    with pytest.raises(warc.BadArchive):
        list(map(warc.parsed, warc.read_records(io.BytesIO(harm(archive()[0])))))


@pytest.mark.parametrize("harm", [
    lambda d: d.replace(b"WARC/1.1", b"WARC/9.9"), lambda d: d.replace(b"WARC-Date", b"X-Date"), lambda d: d[:-1],
    lambda d: d.replace(b"hello", b"jello"), lambda d: d.replace(b"Type: response", b"Type: resource"), lambda d: d.replace(b"Content-Length: 5", b"Content-Length: 6")])
def test_broken_records(harm):
    data = warc.record(1, "u", b"hello", hashlib.sha256(b"hello").hexdigest(), None)
    assert warc.parsed(data)["payload"] == b"hello"
    with pytest.raises(warc.BadArchive):
        warc.parsed(harm(data))
