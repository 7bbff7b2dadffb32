"""Removal of byte strings that an earlier document has, by a distributed suffix sort.

Suffixes are sorted in runs, exchanged front-coded (the length shared with the one before,
and the rest) and merged by loser trees that know how far each contender agrees with the
last winner and so never compare a known prefix again.

Not every suffix has to take part. Of the 35 stretches of 16 bytes in a string of 50, the one
with the smallest hash is the string's anchor, wherever it stands. Two equal strings have
equal anchors, so sorting the suffixes at anchors, each with what stands before it, finds
every equal string. A first exchange, of sorted hashes alone, leaves out the anchors that a
single document has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin.llm.common import query, stored

LENGTH = 50
ANCHOR = 16
REACH = LENGTH - ANCHOR + 1  # anchors in a string; a string starts up to REACH - 1 bytes before its anchor
RECORD = LENGTH + 1 + (REACH - 1) + 1  # what follows, its length, what precedes (backwards), its length
RUN_BYTES = 3 << 20
BUCKET_BYTES = 6 << 20  # of text for each bucket of anchors
BLOCK = 256 << 10
ANCHORS = 32 << 10  # whose records are made or compared at a time
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
LAST_ID = (1 << 63) - 1  # stands for a null doc_id, which comes after all others
ALL = (1 << REACH) - 1

RUNS = "run long, ids array<long>, sizes array<long>, data binary"
PARTS = "kind int, run long, bucket int, n long, data binary"


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers, all first bytes before all second bytes, which packs better."""
    return _pack(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpack(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


# ------------------------------------------------------------------ anchors of a run

def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes at each place, by doubling."""
    with np.errstate(over="ignore"):
        h, base = data.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
        step = 1
        while step < ANCHOR:
            h = h[:-step] * base + h[step:]
            base *= base
            step *= 2
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return np.minimum(h, NONE - np.uint64(1))


def _sliding(h: np.ndarray, width: int, pick) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        h = pick(h[:-done], h[done:])
        done *= 2
    return pick(h[:len(h) - (width - done)], h[width - done:]) if width > done else h


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of all anchors; ``ends`` are the documents' ends."""
    places, values = [], []
    pad = REACH - 1
    n = len(data)
    for at in range(0, n, BLOCK):
        lo, hi = at - pad, min(n, at + BLOCK) + pad  # places whose hashes are needed
        part = np.zeros(hi - lo + ANCHOR - 1, np.uint8)
        a, b = max(lo, 0), min(n, hi + ANCHOR - 1)
        part[a - lo:b - lo] = data[a:b]
        h = _hashes(part)
        # No anchor reaches over the end of a document, or lies outside of the run.
        near = ends[np.searchsorted(ends, lo, "right"):np.searchsorted(ends, hi + ANCHOR, "right")]
        cut = (near[:, None] - np.arange(1, ANCHOR)[None, :]).ravel() - lo
        h[cut[(cut >= 0) & (cut < len(h))]] = NONE
        h[:max(0, -lo)] = NONE
        h[max(0, n - lo):] = NONE
        least = _sliding(h, REACH, np.minimum)
        own = h[pad:len(h) - pad]
        found = np.flatnonzero((_sliding(least, REACH, np.maximum) == own) & (own != NONE))
        places.append(found + at)
        values.append(own[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(values)


class Run:
    """A run of whole documents, its anchors and their distinct hashes in order."""

    def __init__(self, ids, sizes, data: bytes):
        self.ids = np.array([LAST_ID if i is None else i for i in ids], np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.data = np.frombuffer(_unpack(data), np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.places, values = anchors(self.data, self.ends)
        self.docs = np.searchsorted(self.ends, self.places, "right")
        order = np.argsort(values, kind="stable")
        self.places, self.docs, values = self.places[order], self.docs[order], values[order]
        first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
        self.group = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(values)]))))
        self.hashes = values[first]
        owner = self.ids[self.docs]
        differs = (owner[1:] != owner[:-1]) & (self.group[1:] == self.group[:-1])
        self.several = np.bincount(self.group[1:][differs], minlength=len(first)) > 0

    def buckets(self, n: int) -> np.ndarray:
        return ((self.hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _bounds(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of each stretch of sorted bucket numbers."""
    edges = np.flatnonzero(np.diff(buckets)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(buckets)]):
        if b > a:
            yield int(buckets[a]), a, b


# ------------------------------------------------------------------ front coding and merging

def records(run: Run, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix records at anchors ``chosen``: (matrix, bytes after, bytes before)."""
    at, doc = run.places[chosen], run.docs[chosen]
    after = np.minimum(LENGTH, run.ends[doc] - at)
    before = np.minimum(REACH - 1, at - run.starts[doc])
    out = np.zeros((len(at), RECORD), np.uint8)
    for a in range(0, len(at), ANCHORS):
        part = slice(a, a + ANCHORS)
        here, right, left = at[part, None], after[part, None], before[part, None]
        for columns, places, wide in ((slice(0, LENGTH), np.arange(LENGTH), right),
                                      (slice(LENGTH + 1, RECORD - 1), -1 - np.arange(REACH - 1), left)):
            inside = np.arange(len(places)) < wide
            out[part, columns] = np.where(inside, run.data[np.where(inside, here + places, 0)], 0)
    out[:, LENGTH] = after
    out[:, RECORD - 1] = before
    return out, after, before


class Contexts:
    """The distinct records of a run's shared anchors, sorted by bucket and content."""

    def __init__(self, run: Run, shared: np.ndarray, n_buckets: int):
        self.chosen = np.flatnonzero(shared[run.group])
        matrix, self.after, self.before = records(run, self.chosen)
        bucket = run.buckets(n_buckets)[run.group[self.chosen]]
        content = matrix.view(f"V{RECORD}").ravel()
        order = np.argsort(content, kind="stable")
        order = order[np.argsort(bucket[order], kind="stable")]
        self.order, bucket = order, bucket[order]
        new = np.ones(len(order), bool)
        for a in range(1, len(order), ANCHORS):  # the sorted matrix is never made whole
            part = matrix[order[a - 1:a + ANCHORS]]
            new[a:a + ANCHORS] = (part[1:] != part[:-1]).any(axis=1) | (bucket[a:a + ANCHORS] != bucket[a - 1:a - 1 + len(part) - 1])
        first = np.flatnonzero(new)
        self.member = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(order)]))))
        owner = run.ids[run.docs[self.chosen[order]]]
        self.least = np.minimum.reduceat(owner, first) if len(first) else np.zeros(0, np.int64)
        self.owner, self.matrix, self.bucket = owner, matrix[order[first]], bucket[first]

    def coded(self) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, records, front-coded run) of each bucket."""
        for bucket, a, b in _bounds(self.bucket):
            part = self.matrix[a:b]
            agree = np.zeros(len(part), np.int64)
            if len(part) > 1:
                agree[1:] = (part[1:] != part[:-1]).argmax(axis=1)
            tails = b"".join(part[k:k + ANCHORS][np.arange(RECORD) >= agree[k:k + ANCHORS, None]].tobytes() for k in range(0, len(part), ANCHORS))
            ids = self.least[a:b].astype("<i8").view(np.uint8).reshape(-1, 8).T
            body = agree.astype(np.uint8).tobytes() + np.ascontiguousarray(ids).tobytes() + tails
            yield bucket, len(part), _pack(body)


def decoded(n: int, data: bytes) -> Iterator[tuple[int, bytes, int]]:
    """(bytes shared with the record before, record, smallest doc_id) of a front-coded run."""
    body = _unpack(data)
    ids = np.ascontiguousarray(np.frombuffer(body, np.uint8, 8 * n, n).reshape(8, n).T).reshape(-1).view("<i8")
    agree, least, at, before = body[:n], ids.tolist(), 9 * n, b""
    for k in range(n):
        shared = agree[k]
        end = at + RECORD - shared
        before = before[:shared] + body[at:end]
        at = end
        yield shared, before, least[k]


def merge(runs: list[Iterator[tuple[int, bytes, int]]]) -> Iterator[tuple[int, bytes, int, int]]:
    """Merge sorted runs by a loser tree; yields (shared with the one before, record, id, run).

    Each contender is held with the number of bytes it shares with the last winner. Of two
    contenders the one that shares more is smaller; only if they share equally much are
    bytes compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    current: list[tuple[bytes, int] | None] = [None] * size
    shared = [0] * size

    def advance(r: int) -> None:
        item = next(runs[r], None) if r < len(runs) else None
        if item is None:
            current[r], shared[r] = None, -1
        else:
            shared[r], current[r] = item[0], (item[1], item[2])

    def wins(a: int, b: int) -> bool:
        """Whether ``a`` comes first; sets what the loser shares with the winner."""
        x, y = shared[a], shared[b]
        if x != y:
            return x > y
        if x < 0:
            return True
        p, q = current[a][0], current[b][0]
        while x < RECORD and p[x] == q[x]:
            x += 1
        if x == RECORD or p[x] < q[x]:
            shared[b] = x
            return True
        shared[a] = x
        return False

    for r in range(size):
        advance(r)
        if current[r] is not None:
            shared[r] = 0
    losers = [0] * size

    def build(node: int) -> int:
        if node >= size:
            return node - size
        a, b = build(2 * node), build(2 * node + 1)
        if wins(a, b):
            losers[node] = b
            return a
        losers[node] = a
        return b
    winner = build(1) if size > 1 else 0
    while current[winner] is not None:
        record, least = current[winner]
        yield shared[winner], record, least, winner
        advance(winner)
        node = (winner + size) // 2
        while node:
            other = losers[node]
            if not wins(winner, other):
                losers[node], winner = winner, other
            node //= 2


def flags(group: list[tuple[int, bytes, int, int]]) -> list[int]:
    """For each record of an anchor, in order: bit i is set if the string that starts i bytes
    before the anchor also starts in a document with a smaller id than the record's."""
    classes: list[tuple[bytes, int]] = []
    place = []
    for shared, record, least, _ in group:
        if classes and shared == RECORD:
            classes[-1] = (record, min(classes[-1][1], least))
        else:
            classes.append((record, least))
        place.append(len(classes) - 1)
    if len(classes) == 1:
        bits = [0]
    elif len(classes) == 2:
        (p, x), (q, y) = classes
        right, most = 0, min(p[LENGTH], q[LENGTH])
        while right < most and p[right] == q[right]:
            right += 1
        left, most = 0, min(p[-1], q[-1])
        while left < most and p[LENGTH + 1 + left] == q[LENGTH + 1 + left]:
            left += 1
        low = LENGTH - right
        both = ((1 << (left + 1)) - 1) & ~((1 << low) - 1) if left >= low else 0
        bits = [both if y < x else 0, both if x < y else 0]
    else:
        bits = [0] * len(classes)
        for i in range(REACH):
            least_of: dict[bytes, int] = {}
            keys = []
            for record, least in classes:
                if record[LENGTH] < LENGTH - i or record[-1] < i:
                    keys.append(None)
                    continue
                key = record[:LENGTH - i] + record[LENGTH + 1:LENGTH + 1 + i]
                keys.append(key)
                if least < least_of.get(key, LAST_ID + 1):
                    least_of[key] = least
            for c, key in enumerate(keys):
                if key is not None and least_of[key] < classes[c][1]:
                    bits[c] |= 1 << i
    return [ALL if least > classes[c][1] else bits[c] for (_, _, least, _), c in zip(group, place)]


def merged_flags(counts: list[int], blobs: list[bytes]) -> list[np.ndarray]:
    """The flags of every record of each run of a bucket."""
    out = [np.zeros(n, np.int64) for n in counts]
    at = [0] * len(counts)
    group: list[tuple[int, bytes, int, int]] = []

    def close():
        for (_, _, _, r), bits in zip(group, flags(group) if len(group) > 1 else [0]):
            out[r][at[r]] = bits
            at[r] += 1
        group.clear()
    for item in merge([decoded(n, b) for n, b in zip(counts, blobs)]):
        if item[0] < ANCHOR and group:
            close()
        group.append(item)
    if group:
        close()
    return out


# ------------------------------------------------------------------ Spark jobs

def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


_PART_NAMES = ["kind", "run", "bucket", "n", "data"]
_PART_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
HASHES, SHARED, SUFFIXES, FLAGS = range(4)


def to_runs(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Whole documents in runs of about ``run_bytes``, written once; a longer document is a run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0
        names = ["run", "ids", "sizes", "data"]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

        def close():
            return _batch([((task << 32) + made, ids, [len(x) for x in held], _pack(b"".join(held)))], names, types)
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc.as_py())
                held.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(held[-1])
                if size >= run_bytes:
                    yield close()
                    made, ids, held, size = made + 1, [], [], 0
        if ids:
            yield close()
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RUNS), "suffix-runs")


def _rows(table: pa.Table) -> list[dict]:
    return table.to_pylist()


def hash_runs(runs: DataFrame, n_buckets: int) -> DataFrame:
    """The sorted anchor hashes of each run, by bucket, 48 bits of each, as differences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                one, rows = Run(row["ids"], row["sizes"], row["data"]), []
                short = one.hashes >> np.uint64(16)
                for bucket, a, b in _bounds(one.buckets(n_buckets)):
                    steps = np.diff(short[a:b], prepend=np.uint64(0))
                    own = _pack(np.packbits(one.several[a:b]).tobytes())
                    rows.append((HASHES, row["run"], bucket, b - a, len(own).to_bytes(4, "little") + own + _planes(steps)))
                yield _batch(rows, _PART_NAMES, _PART_TYPES)
    return runs.mapInArrow(run, PARTS)


def shared_hashes(hashes: DataFrame) -> DataFrame:
    """Which of each run's hashes another document has, as bits."""
    def run(table: pa.Table) -> pa.Table:
        rows, lists, several = _rows(table), [], []
        for r in rows:
            size = int.from_bytes(r["data"][:4], "little")
            several.append(np.unpackbits(np.frombuffer(_unpack(r["data"][4:4 + size]), np.uint8))[:r["n"]].astype(bool))
            lists.append(np.cumsum(_numbers(r["data"][4 + size:])))
        merged = np.sort(np.concatenate(lists))
        twice = np.unique(merged[1:][merged[1:] == merged[:-1]])
        out = []
        for r, values, own in zip(rows, lists, several):
            at = np.searchsorted(twice, values)
            found = np.zeros(len(values), bool) if not len(twice) else twice[np.minimum(at, len(twice) - 1)] == values
            out.append((SHARED, r["run"], r["bucket"], r["n"], _pack(np.packbits(found | own).tobytes())))
        return pa.Table.from_batches([_batch(out, _PART_NAMES, _PART_TYPES)])
    return stored(hashes.groupBy("bucket").applyInArrow(run, PARTS), "suffix-shared")


def _shared(one: Run, parts: list[dict], n_buckets: int) -> np.ndarray:
    found = {p["bucket"]: np.unpackbits(np.frombuffer(_unpack(p["data"]), np.uint8))[:p["n"]].astype(bool)
             for p in parts if p["kind"] == SHARED}
    out = np.zeros(len(one.hashes), bool)
    for bucket, a, b in _bounds(one.buckets(n_buckets)):
        out[a:b] = found[bucket]
    return out


def suffix_runs(runs: DataFrame, shared: DataFrame, n_buckets: int) -> DataFrame:
    """The front-coded sorted suffix records of each run, by bucket."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, parts = [], _rows(right)
        for row in _rows(left):
            one = Run(row["ids"], row["sizes"], row["data"])
            for bucket, n, data in Contexts(one, _shared(one, parts, n_buckets), n_buckets).coded():
                rows.append((SUFFIXES, row["run"], bucket, n, data))
        return pa.Table.from_batches([_batch(rows, _PART_NAMES, _PART_TYPES)])
    return runs.groupBy("run").cogroup(shared.groupBy("run")).applyInArrow(run, PARTS)


def suffix_flags(suffixes: DataFrame) -> DataFrame:
    """Merge the runs of each bucket; returns the flags of each run's records."""
    def run(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        found = merged_flags([r["n"] for r in rows], [r["data"] for r in rows])
        return pa.Table.from_batches([_batch(
            [(FLAGS, r["run"], r["bucket"], r["n"], _planes(f.astype(np.uint64))) for r, f in zip(rows, found)],
            _PART_NAMES, _PART_TYPES)])
    return stored(suffixes.groupBy("bucket").applyInArrow(run, PARTS), "suffix-flags")


def covered(one: Run, contexts: Contexts, bits: np.ndarray) -> np.ndarray:
    """The bytes of a run that lie in a string of an earlier document."""
    each = np.where(contexts.owner > contexts.least[contexts.member], np.int64(ALL), bits[contexts.member])
    places = one.places[contexts.chosen[contexts.order]]
    after, before = contexts.after[contexts.order], contexts.before[contexts.order]
    starts = np.zeros(len(one.data) + 1, bool)
    for i in range(REACH):
        ok = ((each >> i) & 1 == 1) & (i <= before) & (LENGTH - i <= after)
        starts[places[ok] - i] = True
    total = np.concatenate((np.zeros(LENGTH, np.int32), np.cumsum(starts[:-1], dtype=np.int32)))
    return total[LENGTH:] > total[:-LENGTH]


def apply_flags(runs: DataFrame, parts: DataFrame, n_buckets: int, texts: bool) -> DataFrame:
    """What is left of every document."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * texts]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, parts = [], _rows(right)
        flagged = {p["bucket"]: _numbers(p["data"]).astype(np.int64) for p in parts if p["kind"] == FLAGS}
        for row in _rows(left):
            one = Run(row["ids"], row["sizes"], row["data"])
            contexts = Contexts(one, _shared(one, parts, n_buckets), n_buckets)
            bits = np.zeros(len(contexts.least), np.int64)
            for bucket, a, b in _bounds(contexts.bucket):
                bits[a:b] = flagged[bucket]
            gone = covered(one, contexts, bits)
            for doc, a, b in zip(row["ids"], one.starts.tolist(), one.ends.tolist()):
                part = gone[a:b]
                kept = one.data[a:b][~part].tobytes()
                spans = int(part[:1].sum()) + int((part[1:] & ~part[:-1]).sum())
                rows.append((doc, b - a, int(part.sum()), spans, hashlib.sha256(kept).hexdigest(), *[kept] * texts))
        return pa.Table.from_batches([_batch(rows, names, types)])
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return runs.groupBy("run").cogroup(parts.groupBy("run")).applyInArrow(run, kinds)


def remove_repeats(docs: DataFrame, texts: bool = False, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Take from every document the bytes that lie in a 50-byte string of an earlier one.

    Earlier means a smaller doc_id; null ids come last. Rows with equal ids take nothing
    from each other. A null text is an empty one. With ``texts`` the remaining bytes come
    too. Texts below 50 bytes stay whole. Every row has a row. Other columns are ignored.
    """
    runs = to_runs(docs, run_bytes)
    total = runs.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    n_buckets = max(1, -(-total // BUCKET_BYTES))
    shared = shared_hashes(hash_runs(runs, n_buckets))
    flagged = suffix_flags(suffix_runs(runs, shared, n_buckets))
    return apply_flags(runs, shared.unionByName(flagged), n_buckets, texts)


@query("op2_suffix_dedup")
def op2(t):
    return remove_repeats(t.documents)
