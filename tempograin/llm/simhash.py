"""SimHash near-duplicates through segment popcounts.

A fingerprint is embedded as the bit counts of its two-bit segments. The Manhattan distance
of two embeddings never exceeds the Hamming distance of the fingerprints. With ``limit``
differing bits in at most ``limit`` segments, one of the embedding's three zones differs by
``limit // 3`` at most, so a join on that zone's grid cells, widened by that much, finds every
pair; the pairs are then verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograin.llm.common import LOWER, UPPER, query, stored

SHINGLE = 4
SEED = 42
LIMIT = 4
# Two-bit segments of each zone: 11, 11 and 10 of the 32.
ZONES = [(0, 11), (11, 11), (22, 10)]
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingle_hashes(text: str | None, length: int = SHINGLE) -> np.ndarray:
    """The 64-bit hash of each run of ``length`` words, or of all words if they are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()  # at the six ASCII spaces
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - length + 1)
    last = ends[length - 1:] if len(words) >= length else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)


def fingerprint(text: str | None, length: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles; zero without words."""
    hashes = shingle_hashes(text, length)
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):  # bounded memory for very long texts
        part = hashes[at:at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep, print) for every row; the print is the fingerprint as a signed 64-bit number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(0)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(prints.view(np.int64))], names=[*batch.schema.names[1:], "print"])
    rows = docs.select("text", *keep)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, print long")


def segment_counts(print_: Column) -> Column:
    """The embedding: 32 fields of two bits, each holding the number of bits set in its segment."""
    above = F.shiftrightunsigned(print_, 1)
    low = 0x5555555555555555
    return F.shiftleft(above.bitwiseAND(print_).bitwiseAND(low), 1).bitwiseOR(
        above.bitwiseXOR(print_).bitwiseAND(low))


def _zone(counts: Column, zone: int) -> Column:
    first, n = ZONES[zone]
    return F.shiftrightunsigned(counts, 2 * first).bitwiseAND((1 << 2 * n) - 1)


def _manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of two packed zones."""
    low = 0x5555555555
    # A field of 0, 1 or 2 as a unary code has one bit set for 1 and two for 2.
    def unary(x):
        high = F.shiftrightunsigned(x, 1).bitwiseAND(low)
        ones = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(low)
        return ones.bitwiseOR(F.shiftleft(high, 1))
    return F.bit_count(unary(a).bitwiseXOR(unary(b)))


def zone_cells(prints: DataFrame) -> DataFrame:
    """Each print in its own cell of each zone (``home``) and in the cells one step up (not ``home``).

    Two prints at distance one in a zone are one step apart in one segment, so the lower
    one visits the other's cell.
    """
    seats = []
    for z, (_, n) in enumerate(ZONES):
        own = _zone(segment_counts(F.col("print")), z)
        seats.append(F.struct(F.lit(z).alias("zone"), own.alias("cell"), F.lit(True).alias("home")))
        for j in range(n):
            field = F.shiftrightunsigned(own, 2 * j).bitwiseAND(3)
            seats.append(F.when(field < 2, F.struct(
                F.lit(z).alias("zone"), (own + (1 << 2 * j)).alias("cell"), F.lit(False).alias("home"))))
    return prints.select("*", F.inline(F.filter(F.array(*seats), lambda s: s.isNotNull())))


def _linked(a: Column, b: Column, limit: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= limit


def links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pairs (a, b) of distinct prints in different ``root`` groups with ``limit`` bits between them."""
    if limit // len(ZONES) > 1:
        raise ValueError("three zones reach as far as five bits")
    cells = zone_cells(prints)
    home = cells.filter("home").select("zone", "cell", F.col("print").alias("a"), F.col("root").alias("root_a"))
    other = cells.select(F.col("zone").alias("zone_b"), F.col("cell").alias("cell_b"), F.col("print").alias("b"),
                         F.col("root").alias("root_b"), "home")
    on = ((F.col("zone") == F.col("zone_b")) & (F.col("cell") == F.col("cell_b"))
          & (F.col("root_a") != F.col("root_b"))
          & (~F.col("home") | (F.col("a") < F.col("b"))) & _linked(F.col("a"), F.col("b"), limit))
    # A pair is told by the first zone that can tell it.
    ca, cb = segment_counts(F.col("a")), segment_counts(F.col("b"))
    for z in range(len(ZONES) - 1):
        on = on & ((F.col("zone") <= z) | (_manhattan(_zone(ca, z), _zone(cb, z)) > 1))
    return home.join(other, on).select("a", "b")


def star_links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Links of each print to the smallest print in its cell of each zone, where they hold.

    They join most of a large group of near copies at one link a print.
    """
    cells = stored(zone_cells(prints).filter("home").select("zone", "cell", "print"), "simhash-cells")
    leaders = stored(cells.groupBy("zone", "cell").agg(F.min("print").alias("b"), F.count(F.lit(1)).alias("n"))
                     .filter("n > 1").drop("n"), "simhash-leaders")
    return cells.join(leaders, ["zone", "cell"]).filter(
        (F.col("print") != F.col("b")) & _linked(F.col("print"), F.col("b"), limit)
    ).select(F.col("print").alias("a"), "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the smallest node of each connected component, for all nodes of ``edges``.

    Alternates large-star and small-star steps, each a minimum per node and a join, until
    nothing changes.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a != b").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = stored(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "least")
        large = both.join(least, both["a"] == least["n"]).filter("b > a").select(
            F.col("b").alias("a"), F.least("m", F.col("a")).alias("b"))
        edges = stored(large.filter("a != b").distinct(), "edges")
        least = stored(edges.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")), "least")
        moved = edges.join(least, edges["a"] == least["n"])
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            moved.select(F.col("a"), F.col("m")))
        edges = stored(small.filter("a != b").distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b"), F.col("b")).distinct())
        before = state


def classes(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(print, class) for distinct fingerprints (print): what links of ``limit`` bits reach."""
    stars = components(star_links(prints, limit))
    grouped = stored(prints.join(stars, prints["print"] == stars["node"], "left").select(
        "print", F.coalesce("root", "print").alias("root")), "simhash-grouped")
    # The links that remain join whole groups.
    a = grouped.select(F.col("print").alias("a"), F.col("root").alias("ra"))
    b = grouped.select(F.col("print").alias("b"), F.col("root").alias("rb"))
    joined = components(links(grouped, limit).join(a, "a").join(b, "b").select(
        F.col("ra").alias("a"), F.col("rb").alias("b")))
    return stored(grouped.join(joined, grouped["root"] == joined["node"], "left").select(
        "print", F.coalesce(joined["root"], grouped["root"]).alias("class")), "simhash-classes")


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text).

    Rows with equal fingerprints are one node, so that copies are never paired. Texts
    without words have the fingerprint zero and are linked by it. Null texts have no words.
    Repeated rows get one row each. Rows with a null doc_id take part; ids that are not null
    come first in a component, and one of null ids alone has a null id. Other columns are
    ignored.
    """
    rows = stored(fingerprints(docs), "simhash-prints")
    prints = stored(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = prints.join(classes(prints.select("print"), limit), "print")
    ids = found.groupBy("class").agg(F.min("least").alias("component_id"))
    named = stored(found.join(ids, "class").select("print", "component_id"), "simhash-named")
    return rows.join(named, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near-duplicates.

    Of each component the row with the smallest doc_id stays (null ids come last); among
    rows that share it, one text, and of exact repeats one row.
    """
    whole = docs.select(F.struct("*").alias("_doc"), "text", F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    rows = stored(fingerprints(whole, ("_id", "_hash")), "simhash-prints")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_hash").alias("hash")))
    prints = stored(rows.groupBy("print").agg(first.alias("first")), "simhash-distinct")
    kept = stored(prints.join(classes(prints.select("print"), limit), "print").groupBy("class").agg(
        F.min("first").alias("first")).select(
        F.col("first.id").alias("keep_id"), F.col("first.hash").alias("keep_hash")), "simhash-kept")
    on = (F.col("_hash") == F.col("keep_hash")) & F.col("_id").eqNullSafe(F.col("keep_id"))
    return whole.drop("text").join(kept, on, "left_semi").dropDuplicates(["_hash", "_id"]).select("_doc.*")


@query("op10_simhash")
def op10(t):
    return near_duplicates(t.documents)
