import hashlib
import io
import struct
from base64 import b32encode

import pytest
import zstandard

from tempograin import session
from tempograin.llm import warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string")


def wanted(rows):
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        f = first.get(h or "")
        revisit = f is not None and p != f
        out.append((f"urn:page:{p}", len(raw), b32encode(hashlib.sha1(raw).digest()).decode(),
                    "revisit" if revisit else "response", f"urn:page:{f}" if revisit else None, None))
    return sorted(out, key=repr)


def got(df):
    return sorted([(r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.problem)
                   for r in warc.round_trip(df).collect()], key=repr)


def test_round_trip(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = [tuple(r) for r in df.select("page_id", "url", "html").collect()]
    copies = [(1000 + p, "u", h) for p, _, h in rows[:20]]
    assert got(pages(spark, rows + copies)) == wanted(rows + copies)


def test_odd_and_empty(spark):
    rows = [(5, None, None), (4, "", ""), (6, "http://a/\r\nX: y", "hello\r\n\r\nthere"), (6, "u", "hello\r\n\r\nthere"),
            (None, "u", "hello\r\n\r\nthere"), (None, "u", "alone"), (7, "é", "\x00 é" * 50_000), (8, "é", "\x00 é" * 50_000)]
    assert got(pages(spark, rows)) == wanted(rows)
    assert got(pages(spark, rows).limit(0)) == []


def test_payloads_and_small_archives(spark):
    rows = [(i, "u", f"<p>{i}</p>" * 100) for i in range(200)]
    folder = session.scratch_path(spark, "warc-test")
    listed = warc.write_archives(warc.with_revisits(pages(spark, rows)), folder, archive_bytes=5000)
    assert listed.count() > 10
    back = {r.record_id: bytes(r.payload).decode() for r in warc.read_archives(listed, folder).collect()}
    assert back == {f"urn:page:{i}": h for i, _, h in rows}


def records(n=40):
    return [warc.record(i, f"http://x/{i}", b"payload %d " % i * 50, None, "2024-01-01T00:00:00Z") for i in range(n)]


def read(data):
    return [(warc.parse(raw)["problem"] if problem is None else problem) for raw, problem in warc.frames(io.BytesIO(data))]


@pytest.mark.parametrize("compressed", [False, True])
def test_dictionary_frame_leads(compressed):
    data = warc.pack(records())
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.DICTIONARY_MAGIC and size > 0
    if compressed:
        packed = zstandard.ZstdCompressor().compress(data[8:8 + size])
        data = struct.pack("<II", magic, len(packed)) + packed + data[8 + size:]
    assert read(data) == [None] * 40
    plain = b"".join(zstandard.ZstdCompressor().compress(r) for r in records(3))
    assert read(plain) == [None] * 3


def test_damage_is_told():
    data = warc.pack(records(3))
    assert read(data[:-5])[-1] == "frame is cut short"
    assert read(data[:6]) != [None] * 3
    broken = bytearray(data)
    broken[-40] ^= 0xFF
    assert any(read(bytes(broken)))
    raw = records(1)[0]
    assert warc.parse(raw)["problem"] is None
    assert warc.parse(raw[:-1])["problem"] == "content-length does not match the block"
    assert warc.parse(raw.replace(b"WARC/1.1", b"WARX/1.1"))["problem"] == "no WARC header"
    assert warc.parse(raw.replace(b"WARC-Date", b"WARC-Dote"))["problem"] == "missing warc-date"
    assert warc.parse(raw.replace(b"payload 0 pay", b"payload 1 pay", 1))["problem"] == "payload digest does not match"
    http = raw.replace(b"Content-Length: 500\r\n\r\n", b"Content-Length: 501\r\n\r\n")
    assert warc.parse(http)["problem"] == "payload length does not match"
