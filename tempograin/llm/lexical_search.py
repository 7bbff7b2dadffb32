"""Ranked lexical search with MaxScore and bounds for pairs of terms.

The forward index holds, for every document, its length and how often each wanted term occurs
in it. From it two kinds of list are precomputed: for a term the largest impact it has in any
document, and for two terms that are neighbours in some item's order of weights the largest
joint impact in a document that holds both (their intersection). Each list also says how large
an impact the k-th best document surely has.

A query's terms are ordered by weight. The bound of the lightest ``j`` terms is the least sum
that single terms and neighbouring pairs give for them; it is tighter than the sum of the
terms' own maxima, because two terms rarely have their maxima in one document. Terms whose
joint bound lies below the score that a result needs cannot make a result alone, so documents
are found through the other terms only; then the lighter terms are added, heaviest first, and
a document is dropped as soon as what may still come cannot lift it to that score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempograin.llm.common import LOWER, UPPER, lower_ascii, query, stored

BEST = 50
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LETTERS = b"0123456789" + UPPER.encode() + LOWER.encode()
#: Upper case to lower case, what separates terms to a space.
FOLD = bytes(b if b > 127 or b in LETTERS else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
SLICE_BYTES = 4 << 20
TERMS_PER_BLOCK = 50_000  # of items whose results are found in one pass
ENTRIES = 400_000  # of the index that a task looks at together
SHARE = 1_000_000  # an impact is less than the weight times this
BUCKETS = 64
INDEX = "doc_id long, n long, terms array<int>, tfs array<int>"


def term_counts(text: str | None, number: dict[bytes, int]) -> tuple[int, Counter]:
    """The number of terms of a whole text, and how often each numbered one occurs (others under None)."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(FOLD)
    n, counts, at = 0, Counter(), 0
    while at < len(raw):  # a slice at a time, so that a very long text does not become one list
        end = raw.find(b" ", at + SLICE_BYTES) if len(raw) - at > SLICE_BYTES else -1
        words = raw[at:end if end >= 0 else len(raw)].split() if at or end >= 0 else raw.split()
        n += len(words)
        counts.update(map(number.get, words))
        at = end if end >= 0 else len(raw)
    return n, counts


def forward_index(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, tfs) for every row of ``docs``; terms are places in ``vocabulary``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t.encode("utf-8", "surrogatepass"): i for i, t in enumerate(vocabulary)}
        for batch in batches:
            ns, sizes, terms, tfs = [], [0], [], []
            for text in batch.column(1):
                n, counts = term_counts(text.as_py(), number)
                counts.pop(None, None)
                ns.append(n)
                terms.extend(counts)
                tfs.extend(counts.values())
                sizes.append(len(terms))
            at = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))], names=["doc_id", "n", "terms", "tfs"])
    return docs.select("doc_id", "text").mapInArrow(run, INDEX)


@dataclass
class Weights:
    """What turns counts into impacts: corpus sizes and the weight of each term."""

    documents: int
    length: int
    w: np.ndarray

    @classmethod
    def of(cls, index: DataFrame, n_terms: int) -> Weights:
        documents, length = index.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        df = np.zeros(n_terms, np.int64)
        for term, n in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row per wanted term at most
            df[term] = n
        w = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) if x else 0 for x in df]
        return cls(documents, length or 0, np.array(w, np.int64))

    def impacts(self, terms: np.ndarray, tfs: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 50 + (50 * n * self.documents) // self.length
        return self.w[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m))


class Postings:
    """The postings of a few documents: for each term the places of its documents and its impacts there."""

    def __init__(self, part: pa.RecordBatch, weights: Weights):
        lists = part.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        terms = lists.flatten().to_numpy()
        places = np.repeat(np.arange(part.num_rows), sizes)
        n = part.column(1).to_numpy()
        impacts = weights.impacts(terms, part.column(3).flatten().to_numpy().astype(np.int64), n[places])
        order = np.argsort(terms, kind="stable")
        self.size = part.num_rows
        self.places, self.impacts = places[order], impacts[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(weights.w) + 1))

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[term], self.starts[term + 1]
        return self.places[a:b], self.impacts[a:b]

    def at(self, term: int, places: np.ndarray) -> np.ndarray:
        """The impacts of a term in the documents at ``places``; zero where it does not occur."""
        own, impacts = self.of(term)
        if not len(own):
            return np.zeros(len(places), np.int64)
        found = np.minimum(np.searchsorted(own, places), len(own) - 1)
        return np.where(own[found] == places, impacts[found], 0)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of the index, cut to a bounded number of entries (a single document has at most one per wanted term)."""
    for batch in batches:
        ends = batch.column(2).offsets.to_numpy()
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + ENTRIES, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def impact_lists(index: DataFrame, weights: Weights, pairs: np.ndarray, best: int) -> DataFrame:
    """(pair, id, most, kth): the largest impact of each term, or joint impact of each pair, and a floor of its k-th largest.

    ``kth`` is null for lists of fewer than ``best`` documents. Impacts are counted in equal
    ranges up to the most that the weights allow, so a task keeps a fixed number of counts.
    """
    n_terms = len(weights.w)
    tops = np.concatenate([weights.w, weights.w[pairs[:, 0]] + weights.w[pairs[:, 1]]]) * SHARE + 1
    shared = [(i, int(a), int(b)) for i, (a, b) in enumerate(pairs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(tops), BUCKETS), np.int32)
        most = np.full(len(tops), -1, np.int64)
        for part in parts(batches):
            postings = Postings(part, weights)
            terms = np.repeat(np.arange(n_terms), np.diff(postings.starts))
            np.maximum.at(most, terms, postings.impacts)
            counts += np.bincount(terms * BUCKETS + postings.impacts * BUCKETS // tops[terms], minlength=counts.size).reshape(counts.shape).astype(np.int32)
            for i, a, b in shared:
                places, impacts = postings.of(a)
                other, others = postings.of(b)
                if not len(places) or not len(other):
                    continue
                if len(other) < len(places):
                    places, impacts, other, others = other, others, places, impacts
                found = np.minimum(np.searchsorted(other, places), len(other) - 1)
                both = other[found] == places
                joint = impacts[both] + others[found[both]]
                if len(joint):
                    most[n_terms + i] = max(most[n_terms + i], joint.max())
                    counts[n_terms + i] += np.bincount(joint * BUCKETS // tops[n_terms + i], minlength=BUCKETS).astype(np.int32)
        ids, buckets = np.nonzero(counts)
        if len(ids):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(buckets, pa.int64()), pa.array(counts[ids, buckets], pa.int64()), pa.array(most[ids])],
                names=["id", "bucket", "docs", "most"])
    seen = index.mapInArrow(run, "id long, bucket long, docs long, most long").groupBy("id", "bucket").agg(
        F.sum("docs").alias("docs"), F.max("most").alias("most"))
    down = Window.partitionBy("id").orderBy(F.desc("bucket"))
    reached = F.max(F.when(F.col("above") >= best, F.col("bucket"))).alias("kth")
    return stored(seen.withColumn("above", F.sum("docs").over(down)).groupBy("id").agg(F.max("most").alias("most"), reached, F.sum("docs").alias("docs")), "search-lists")


@dataclass
class Plan:
    """One item's query: terms by rising weight, the bound of each prefix, and a score its results surely reach."""

    terms: list[int]
    bounds: list[int]
    floor: int

    def heavy(self, needed: int) -> int:
        """How many of the lightest terms cannot reach ``needed`` together."""
        light = 0
        while light < len(self.terms) and self.bounds[light + 1] < needed:
            light += 1
        return light


def plans(items: list[list[int]], weights: Weights, lists: dict[int, tuple[int, int | None]], pair_ids: dict[tuple[int, int], int]) -> list[Plan]:
    """The plan of each item from the lists' maxima."""
    n_terms = len(weights.w)

    def least(i: int) -> int:
        """The smallest impact counted in the range of the list's k-th largest."""
        bucket = lists[i][1] if i in lists else None
        if bucket is None:
            return 0
        a = weights.w[i] if i < n_terms else sum(weights.w[t] for t in by_id[i - n_terms])
        return -(-bucket * (int(a) * SHARE + 1) // BUCKETS)
    by_id = {i: p for p, i in pair_ids.items()}
    out = []
    for terms in items:
        most = [lists.get(t, (0, None))[0] for t in terms]
        bounds, floor = [0], 0
        for j, t in enumerate(terms):
            bound = bounds[j] + most[j]
            floor = max(floor, least(t))
            if j:
                i = n_terms + pair_ids[terms[j - 1], t]
                # A document has both terms, only the one, or only the other.
                bound = min(bound, bounds[j - 1] + max(lists.get(i, (0, None))[0], most[j - 1], most[j]))
                floor = max(floor, least(i))
            bounds.append(bound)
        out.append(Plan(terms, bounds, floor))
    return out


class Top:
    """The best documents of one item so far: highest score, then smallest id, null ids last."""

    def __init__(self, best: int, floor: int):
        self.best, self.needed = best, max(1, floor)
        self.scores, self.ids, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        scores, ids, none = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids)), np.concatenate((self.none, none))
        order = np.lexsort((ids, none, -scores))[:self.best]
        self.scores, self.ids, self.none = scores[order], ids[order], none[order]
        if len(order) == self.best:
            self.needed = max(self.needed, int(self.scores[-1]))


def best_of(postings: Postings, plan: Plan, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the documents that score ``needed`` or more."""
    light = plan.heavy(needed)
    scores = np.zeros(postings.size, np.int64)
    for t in plan.terms[light:]:
        places, impacts = postings.of(t)
        scores[places] += impacts
    places = np.flatnonzero((scores > 0) & (scores + plan.bounds[light] >= needed))
    scores = scores[places]
    for j in range(light - 1, -1, -1):
        if not len(places):
            break
        scores = scores + postings.at(plan.terms[j], places)
        keep = scores + plan.bounds[j] >= needed
        places, scores = places[keep], scores[keep]
    return places, scores


def ranked(index: DataFrame, weights: Weights, queries: list[tuple[int, Plan]], best: int) -> DataFrame:
    """(_item, doc_id, score): each task's best documents for each query, reduced to the best of all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [Top(best, p.floor) for _, p in queries]
        for part in parts(batches):
            postings = Postings(part, weights)
            ids = part.column(0).fill_null(0).to_numpy()
            none = part.column(0).is_null().to_numpy(zero_copy_only=False)
            for (_, plan), top in zip(queries, tops):
                places, scores = best_of(postings, plan, top.needed)
                if len(places):
                    top.add(scores, ids[places], none[places])
        for (item, _), top in zip(queries, tops):
            if len(top.scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(top.scores), item)), pa.array(top.ids, mask=top.none), pa.array(top.scores)], names=["_item", "doc_id", "score"])
    found = index.mapInArrow(run, "_item long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # First within a few groups of documents, so that no task takes all that an item's tasks found.
    some = Window.partitionBy("_item", F.pmod(F.xxhash64("doc_id"), F.lit(32))).orderBy(*order)
    every = Window.partitionBy("_item").orderBy(*order)
    fewer = found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= best).drop("rank")
    return fewer.withColumn("rank", F.row_number().over(every)).filter(F.col("rank") <= best)


def wanted_terms(items: DataFrame) -> DataFrame:
    """(_item, item_id, terms) for the distinct item ids that have terms; rows that share an id are one item."""
    terms = items.select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(
        lower_ascii(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0)))).alias("term"))
    return stored(terms.distinct().groupBy("item_id").agg(F.array_sort(F.collect_list("term")).alias("terms")).select(
        F.monotonically_increasing_id().alias("_item"), "item_id", "terms"), "search-items")


def _block(docs: DataFrame, items: list[tuple[int, list[str]]], best: int) -> DataFrame | None:
    """The results of a bounded block of items; None if no document has a term."""
    vocabulary = sorted({t for _, terms in items for t in terms})
    place = {t: i for i, t in enumerate(vocabulary)}
    index = stored(forward_index(docs, vocabulary), "search-index")
    weights = Weights.of(index, len(vocabulary))
    if not weights.length:
        return None
    ordered = [sorted((place[t] for t in terms), key=lambda i: (weights.w[i], i)) for _, terms in items]
    pair_ids: dict[tuple[int, int], int] = {}
    for terms in ordered:
        for pair in zip(terms, terms[1:]):
            pair_ids.setdefault(pair, len(pair_ids))
    pairs = np.array(list(pair_ids), np.int64).reshape(-1, 2)
    lists = {r["id"]: (r["most"], r["kth"]) for r in impact_lists(index, weights, pairs, best).collect()}  # one row per term and pair
    made = plans(ordered, weights, lists, pair_ids)
    return ranked(index, weights, [(item, p) for (item, _), p in zip(items, made)], best)


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of each item, all of them if fewer score above 0.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored,
    whatever their names. Equal scores are ranked by doc_id, null ids last. Repeated documents
    are documents of their own. Items of one id, null included, are one item with the terms of
    all. Null and empty texts have no terms: such documents score nothing and such items have
    no rows. Items are taken in blocks of a bounded number of terms, each against all
    documents; an item's own distinct terms must fit in memory.
    """
    wanted = wanted_terms(items)
    total = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // TERMS_PER_BLOCK)
    done = None
    for b in range(blocks):
        own = wanted.filter(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == b)
        rows = [(r["_item"], r["terms"]) for r in own.select("_item", "terms").collect()]  # bounded by the block
        out = _block(docs, rows, best) if rows else None
        if out is not None:
            done = out if done is None else done.unionByName(out)
    if done is None:
        return items.sparkSession.createDataFrame([], "_item long, rank int, doc_id long, score long").join(
            wanted, "_item").select("item_id", "rank", "doc_id", "score")
    return done.join(wanted.select("_item", "item_id"), "_item").select("item_id", "rank", "doc_id", "score")


ORACLE = rf"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS big_n, sum(len(ts))::BIGINT AS big_l FROM w),
tf AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM w) GROUP BY r, term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS wt FROM tf, s GROUP BY term),
sc AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(wt * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * big_n) // big_l)))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN wt USING (term), s GROUP BY item_id, r),
rk AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT * FROM rk WHERE rank <= {BEST}"""


@query("op12_pair_maxscore", ORACLE)
def op12(t):
    return search(t.documents, t.benchmark)
