"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates share a SimHash component (:mod:`tempograin.llm.simhash`, four bits, with its grid
join) or all minima of one of 32 bands of six hash functions. The bands are there because 64 bits
are too coarse at 0.8, where fingerprints differ in up to 14 bits; a pair at 0.8 exactly is
missed by bands and sketches with a chance of 8 in 100,000, a closer one less often. Every link is checked exactly
on the shingles of the two texts.

Cells are the components and the keys of the bands. Most of a large cell is joined through one
leader. What is left in cells with several groups often has shingles that no other candidate
has, and these bound its similarity to any of them. The other members are compared in blocks:
a task takes two blocks of a cell and counts the shingles that their members share as one matrix
product, so a cell of any size makes no row a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin.llm import simhash
from tempograin.llm.common import stored
from tempograin.llm.simhash import components, shingle_hashes

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 6
FIELDS = 768  # minima of a sketch
# Of 768 fields of two bits, a pair at 0.8 differs in 115 on average and in more than this with a chance of 2 in 100,000.
DIFFERING = 156
SALTS = 64
BLOCK = 1024  # members of a cell in one block,
BLOCK_SHINGLES = 1 << 20  # and about how many shingles they have together
COLUMNS = 8192  # shingles counted in one matrix product
# Multiply and add, modulo 2 ** 64, of each hash function; the multipliers are odd.
_DRAWN = np.random.Generator(np.random.PCG64(42)).integers(0, 2 ** 64, (2, FIELDS), np.uint64)
_TIMES, _PLUS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, in order; empty without words."""
    return np.unique(shingle_hashes(text, SHINGLE))


def minima(shingles: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The least value of each of the first ``n`` hash functions."""
    least = np.full(n, 2 ** 64 - 1, np.uint64)
    for at in range(0, len(shingles), 4096):  # bounded memory for very long texts
        mixed = shingles[at:at + 4096, None] * _TIMES[:n] + _PLUS[:n]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, mixed.min(axis=0), out=least)
    return least


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of minima."""
    least = minima(shingles).reshape(BANDS, ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(least)), np.uint64, BANDS)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Two bits of each of 768 minima, 32 fields to a number."""
    fields = (minima(shingles, FIELDS) >> np.uint64(3) & np.uint64(3)).reshape(-1, 32)
    return np.bitwise_or.reduce(fields << np.arange(0, 64, 2, dtype=np.uint64), axis=1)


def signatures(whole: DataFrame) -> DataFrame:
    """(_id, _hash, node, n, print, keys) for rows of (text, _id, _hash): equal shingle sets are one ``node``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(0)]
            nodes = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), 1) for s in sets), np.uint64, len(sets))
            prints = np.fromiter((simhash.fingerprint(t.as_py()) for t in batch.column(0)), np.uint64, len(sets))
            keys = [band_keys(s).view(np.int64) if len(s) else np.empty(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(nodes.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(prints.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                names=[*batch.schema.names[1:], "node", "n", "print", "keys"])
    rows = whole.select("text", "_id", "_hash")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("_id", "_hash"))
    return rows.mapInArrow(run, f"{kinds}, node long, n long, print long, keys array<long>")


def _alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts have the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            last, right = None, None
            for x, y in zip(batch.column(2), batch.column(3)):
                if last is None or y.as_py() != last:
                    last = y.as_py()
                    right = shingle_set(last)
                left = shingle_set(x.as_py())
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(5 * both >= 4 * (len(left) + len(right) - both))  # 0.8, in whole numbers
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    both = pairs
    for node, text in (("a", "left"), ("b", "right")):
        # A node with many partners has its text once for each of their salts, so that they are not one task.
        other = "b" if node == "a" else "a"
        salted = both.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(SALTS)))
        own = salted.select(node, "_salt").distinct().join(texts.select(F.col("node").alias(node), F.col("text").alias(text)), node)
        both = salted.join(own, [node, "_salt"]).drop("_salt")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _length_fits(a: str, b: str):
    """Sets at the similarity differ in size by no more than it allows."""
    return F.least(F.col(a), F.col(b)) * 5 >= F.greatest(F.col(a), F.col(b)) * 4


def sketches(texts: DataFrame) -> DataFrame:
    """(node, sketch) of ``texts`` (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(shingle_set(t.as_py())).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "sketch"])
    return texts.select("node", "text").mapInArrow(run, "node long, sketch array<long>")


def own_shingles(texts: DataFrame) -> DataFrame:
    """(node, n_own): how many shingles of each of ``texts`` (node, text) none of the others has, where there are such."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1)):
                found = shingle_set(text.as_py())
                for at in range(0, len(found), 65536):  # bounded batches for very long texts
                    part = found[at:at + 65536].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), node.as_py())), pa.array(part)], names=["node", "shingle"])
    places = texts.select("node", "text").mapInArrow(run, "node long, shingle long")
    owners = places.groupBy("shingle").agg(F.count(F.lit(1)).alias("_nodes"), F.min("node").alias("node"))
    return owners.filter("_nodes = 1").groupBy("node").agg(F.count(F.lit(1)).alias("n_own"))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, shingles) of ``texts`` (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "shingles"])
    return texts.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def _still_open(members: DataFrame) -> DataFrame:
    """The members of cells with more than one root, and into how many ``blocks`` each cell is cut."""
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    cells = members.groupBy("band", "key").agg(F.min("root").alias("_least"), F.max("root").alias("_most"), parts.alias("blocks"))
    return members.join(cells.filter("_least != _most").select("band", "key", "blocks"), ["band", "key"])


def _agreeing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which sketches (a row each) agree as much as those of near copies do."""
    differing = np.zeros((len(left), len(right)), np.uint16)
    for i in range(left.shape[1]):
        x = left[:, i, None] ^ right[None, :, i]
        differing += np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return differing <= DIFFERING


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``left`` has in common with each of ``right``; both hold sorted distinct values."""
    sets, n_left = left + right, len(left)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    again = times[column] > 1
    owner, column = owner[again], (np.cumsum(times > 1) - 1)[column[again]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n_left, len(sets) - n_left), np.int64)
    width = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, width, COLUMNS):
        first, last = np.searchsorted(column, (at, at + COLUMNS))
        has = np.zeros((len(sets), min(COLUMNS, width - at)), np.float32)
        has[owner[first:last], column[first:last] - at] = 1
        both += (has[:n_left] @ has[n_left:].T).astype(np.int64)
    return both


def _joined(root: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two lists of members, so that links between ``left`` and ``right`` join what the pairs of both lists join."""
    may = _agreeing(sketch[left], sketch[right]) & (root[left][:, None] != root[right][None, :])
    left, right, may = left[may.any(axis=1)], right[may.any(axis=0)], may[may.any(axis=1)][:, may.any(axis=0)]
    none = np.empty(0, np.int64)
    if not len(left):
        return none, none
    both = _shared([sets[i] for i in left], [sets[i] for i in right])
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    linked = may & (5 * both >= 4 * (size[left][:, None] + size[right][None, :] - both))  # 0.8, in whole numbers
    least = np.arange(len(sets))  # the smallest member that each is joined with
    while linked.any():
        before = least.copy()
        far = len(sets)
        least[left] = np.minimum(least[left], np.where(linked, least[right][None, :], far).min(axis=1))
        least[right] = np.minimum(least[right], np.where(linked, least[left][:, None], far).min(axis=0))
        if (least == before).all():
            break
    moved = np.flatnonzero(least != np.arange(len(sets)))
    return moved, least[moved]


def _block_links(members: DataFrame) -> DataFrame:
    """Pairs (a, b) that join what the links inside the cells of ``members`` join.

    ``members`` are (band, key, one, two, block, node, root, sketch, shingles): the rows of a cell's
    blocks ``one`` and ``two`` are compared by one task, each with those of the other block.
    """
    def compared(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        one, two, block, node, root = (rows.column(i).to_numpy() for i in range(2, 7))
        if len(node) < 2 or (root == root[0]).all():
            return node[:0], node[:0]
        sketch = np.concatenate([c.flatten().to_numpy() for c in rows.column(7).chunks]).view(np.uint64).reshape(len(node), -1)
        sets = [s.values.to_numpy() for s in rows.column(8)]
        a, b = _joined(root, sketch, sets, np.flatnonzero(block == one), np.flatnonzero(block == two))
        return node[a], node[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            starts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            done = []
            for at, end in zip(starts, starts[1:]):
                if held and (place[at] != last).any():
                    done.append(compared(held))
                    held = []
                last = place[at]
                held.append(batch.slice(at, end - at))
            for a, b in done:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if held:
            a, b = compared(held)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
    place = ["band", "key", "one", "two"]
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(tasks, *place).sortWithinPartitions(*place).mapInArrow(run, "a long, b long")


def classes(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, class) for distinct nodes (node, n, print, keys); ``texts`` gives (node, text) of the nodes asked for."""
    def alike(pairs: DataFrame) -> DataFrame:
        asked = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "near-asked")
        return stored(_alike(pairs, stored(texts(asked), "near-texts")), "near-alike")
    prints = stored(nodes.select("print").distinct(), "near-prints")
    near = nodes.select("node", "n", "print").join(simhash.classes(prints), "print")
    cells = stored(nodes.select("node", "n", F.posexplode("keys").alias("band", "key")).unionByName(
        near.select("node", "n", F.lit(BANDS).alias("band"), F.col("class").alias("key"))), "near-cells")
    # First the smallest node of each cell: one candidate a row joins most of a large group.
    leaders = stored(cells.groupBy("band", "key").agg(F.min(F.struct("node", "n")).alias("lead"), F.count(F.lit(1)).alias("_rows"))
                     .filter("_rows > 1").select("band", "key", F.col("lead.node").alias("b"), F.col("lead.n").alias("n_b")), "near-leaders")
    shared = stored(cells.join(leaders, ["band", "key"]), "near-shared")
    stars = stored(shared.filter(F.col("node") != F.col("b")).filter(_length_fits("n", "n_b"))
                   .select(F.col("node").alias("a"), "b").distinct(), "near-stars")
    links = alike(stars)
    rooted = components(links)
    grouped = stored(shared.join(rooted, "node", "left").select(
        "band", "key", "node", "n", F.coalesce("root", "node").alias("root")), "near-grouped")
    # What cells with several groups hold, with what bounds its similarity to the others.
    still = stored(_still_open(grouped).drop("blocks"), "near-still")
    wanted = stored(texts(still.select("node").distinct()), "near-wanted")
    own = stored(own_shingles(wanted), "near-own")
    # No candidate meets a node in more shingles than others have of it; with less than 0.8 of them it has no near copy.
    met = F.col("n") - F.coalesce("n_own", F.lit(0))
    left = stored(_still_open(still.join(own, "node", "left").filter(5 * met >= 4 * F.col("n")).drop("n_own")), "near-open")
    asked = wanted.join(left.select("node").distinct(), "node", "left_semi")
    held = stored(shingle_sets(asked).join(sketches(asked), "node"), "near-sets")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    spread = left.withColumn("block", block).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = spread.select("band", "key", F.least("block", "_other").alias("one"), F.greatest("block", "_other").alias("two"), "block", "node", "root")
    found = stored(_block_links(stored(rows, "near-round").join(held, "node").select(*rows.columns, "sketch", "shingles")), "near-pairs")
    joined = components(links.unionByName(found))
    return stored(nodes.select("node").join(joined, "node", "left").select(
        "node", F.coalesce("root", "node").alias("class")), "near-classes")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near copies.

    Groups are what links of the similarity reach. Of each the row with the smallest doc_id
    stays (null ids come last); among rows that share it, one text, and of exact repeats one
    row. Texts without words, null among them, are one group.
    """
    whole = docs.select(F.struct("*").alias("_doc"), "text", F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    rows = stored(signatures(whole), "near-signatures")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_hash").alias("hash")))
    nodes = stored(rows.groupBy("node").agg(
        first.alias("first"), *[F.first(c).alias(c) for c in ("n", "keys")], F.min("print").alias("print")), "near-nodes")
    on = (F.col("_hash") == F.col("first.hash")) & F.col("_id").eqNullSafe(F.col("first.id"))

    def texts(asked: DataFrame) -> DataFrame:
        """The texts of some nodes, each from its first row."""
        rows = whole.select("text", "_id", "_hash").join(nodes.select("node", "first").join(asked, "node"), on)
        return rows.select("node", "text").dropDuplicates(["node"])
    kept = stored(nodes.join(classes(nodes.select("node", "n", "print", "keys"), texts), "node").groupBy("class").agg(
        F.min("first").alias("first")), "near-kept")
    return whole.drop("text").join(kept, on, "left_semi").dropDuplicates(["_hash", "_id"]).select("_doc.*")
