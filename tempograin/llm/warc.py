"""WARC archives compressed with Zstandard, one frame a record.

An archive begins with a skippable frame that holds the dictionary its records are
compressed with. The reader loads it, decodes frame after frame and checks every record's
headers and lengths.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin import session
from tempograin.llm.common import query, same, stored

# Fixed values of the format: frame magics, record types and the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

ARCHIVE_BYTES = 16 << 20  # of records before compression
ARCHIVES_PER_TASK = 8  # when read
DICTIONARY_BYTES = 32 << 10
SAMPLES = 128  # records of an archive that its dictionary is made from
CHUNK = 64 << 10
URN = "urn:page:"
RESULT = ("archive string, record_id string, record_type string, target_uri string, payload_digest string, "
          "payload_bytes long, refers_to string, payload binary, problem string")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """One record; with ``refers_to`` (a string) a revisit, which leaves the payload out."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    revisit = refers_to is not None
    block = http if revisit else http + payload
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else "about:blank"
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{URN}{page_id}>"),
            ("WARC-Date", date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}")]
    if revisit:
        head += [("WARC-Refers-To", f"<{URN}{refers_to}>"), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in head)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive of ``records``; too few records to train on leave the dictionary empty."""
    samples = records[:SAMPLES]
    try:
        dictionary = zstandard.train_dictionary(
            min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        dictionary = b""
    writer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True,
                                      dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary + b"".join(map(writer.compress, records))


def frames(stream) -> Iterator[tuple[bytes, str | None]]:
    """(record bytes, problem) of each frame of an archive, read in small pieces."""
    head = stream.read(8)
    dictionary, rest = None, head
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<II", head)[1]
        content, rest = stream.read(size), b""
        if len(content) < size:
            yield b"", "dictionary frame is cut short"
            return
        if content[:4] == struct.pack("<I", FRAME_MAGIC):
            content = zstandard.ZstdDecompressor().decompress(content)
        dictionary = zstandard.ZstdCompressionDict(content) if content else None
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while rest or (rest := stream.read(CHUNK)):
        frame, parts = reader.decompressobj(), []
        try:
            while not frame.eof:
                if not rest and not (rest := stream.read(CHUNK)):
                    yield b"", "frame is cut short"
                    return
                parts.append(frame.decompress(rest))
                rest = frame.unused_data if frame.eof else b""
        except zstandard.ZstdError as e:
            yield b"", f"frame cannot be decoded: {e}"
            return
        yield b"".join(parts), None


def parse(raw: bytes) -> dict:
    """The fields of one record; ``problem`` says what is wrong with it, if anything."""
    out = dict.fromkeys(("record_id", "record_type", "target_uri", "payload_digest", "payload_bytes",
                         "refers_to", "payload", "problem"))
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", VERSION):
        return out | {"problem": "no WARC header"}
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            return out | {"problem": "malformed header line"}
        fields[name.strip().lower()] = value.strip()
    out |= {"record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": fields.get("warc-type"),
            "target_uri": fields.get("warc-target-uri"),
            "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "refers_to": fields.get("warc-refers-to", "").strip("<>") or None}
    if missing := [k for k in REQUIRED if k not in fields]:
        return out | {"problem": f"missing {missing[0]}"}
    if not fields["content-length"].isdigit():
        return out | {"problem": "content-length is no number"}
    if len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        return out | {"problem": "content-length does not match the block"}
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    length = next((x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
    if not gap or not length.isdigit():
        return out | {"problem": "no payload length"}
    out["payload_bytes"] = int(length)
    if out["record_type"] == "revisit":
        return out | {"problem": None if out["refers_to"] and not payload else "revisit without a target or with a payload"}
    if len(payload) != int(length):
        return out | {"problem": "payload length does not match"}
    if out["payload_digest"] and payload_digest(payload) != out["payload_digest"]:
        return out | {"problem": "payload digest does not match"}
    return out | {"payload": payload}


# ------------------------------------------------------------------ Spark jobs

def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): equal payloads of ``least`` bytes refer to the smallest page_id.

    The table of first pages is written before it is joined, so that Spark can split a
    payload that many pages share.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("_digest"),
                        F.octet_length(html).alias("_bytes"))
    firsts = stored(rows.filter(F.col("_bytes") >= least).groupBy("_digest").agg(
        F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"), "warc-firsts")
    joined = rows.join(firsts, "_digest", "left")
    refers = F.when(F.col("_first").isNotNull() & ~same(F.col("page_id"), F.col("_first")), F.col("_first"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z",
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, html, refers_to) as archives below ``folder``; returns their list.

    Each attempt at a task writes files of its own; the list, which Spark commits, names
    those of the attempts that counted.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task, names, counts, held, size = TaskContext.get().partitionId(), [], [], [], 0

        def flush():
            name = f"{task:06d}-{len(names):06d}-{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(pack(held))
            names.append(name)
            counts.append(len(held))
            held.clear()
        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(i) for i in range(4))):
                raw = record(page.as_py(), url.as_py(), html.as_py().encode("utf-8", "surrogatepass"), refers.as_py(), date)
                held.append(raw)
                size += len(raw)
                if size >= archive_bytes:
                    flush()
                    size = 0
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())],
                                         names=["archive", "records"])
    ready = pages.select("page_id", "url", "html", "refers_to")
    return stored(ready.mapInArrow(write, "archive string, records long"), "warc-list")


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record of the listed archives; damaged ones have a ``problem``."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        schema = pa.schema([("archive", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()),
                            ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                            ("refers_to", pa.string()), ("payload", pa.binary()), ("problem", pa.string())])

        def emit(rows):
            return pa.RecordBatch.from_pylist(rows, schema)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}") as stream:
                    for raw, problem in frames(stream):
                        fields = {"problem": problem} if problem else parse(raw)
                        if not payloads:
                            fields["payload"] = None
                        rows.append({"archive": name} | fields)
                        size += len(raw) if payloads else 500
                        if size >= 4 << 20:
                            yield emit(rows)
                            rows, size = [], 0
                yield emit(rows)
    # Names are short however large the archives: an explicit count keeps adaptive execution
    # from merging them into one task.
    n = archives.count()
    tasks = max(-(-n // ARCHIVES_PER_TASK), min(n, archives.sparkSession.sparkContext.defaultParallelism), 1)
    return archives.select("archive").repartition(tasks).mapInArrow(read, RESULT)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) in the shared folder and read the archives back.

    A null html is an empty payload, a null url is written as about:blank, a null page_id as
    None. Rows that repeat both the id and the payload of the first are responses too. An
    empty table gives no archives and an empty result. Other columns are ignored. Records
    that cannot be read come back with a ``problem``; none is left out.
    """
    folder = session.scratch_path(pages.sparkSession, "warc")
    listed = write_archives(with_revisits(pages), folder)
    return read_archives(listed, folder, payloads=False)


@query("op8_warc_zstd")
def op8(t):
    def number(name):
        return F.expr(f"try_cast(substring({name}, {len(URN) + 1}) AS bigint)")
    return round_trip(t.pages).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"), "problem")
