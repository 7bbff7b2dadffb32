"""Benchmark decontamination with a positional inverted index.

The index stores, for the terms that matter, where they stand in the training documents. A
benchmark phrase is looked up from its rarest terms: their posting lists are shifted by the
term's offset in the phrase and intersected, and what is left is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograin.llm.common import broadcast_if_small, let, lower_ascii, query, stored

WINDOW = 10
LISTS = 2  # posting lists that are intersected before words are compared
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    """The words of a text, lower-cased and joined by single spaces; empty for null."""
    return F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS, " "))


def split_words(joined: Column) -> Column:
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def numbered_documents(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(_row, keep, n_words, words): one numbered row per input row, written once."""
    words = docs.select(*keep, normal_words(F.col("text")).alias("words"))
    return stored(words.select(
        F.monotonically_increasing_id().alias("_row"), *keep,
        F.when(F.col("words") == "", F.lit(0)).otherwise(
            F.length("words") - F.length(F.replace(F.col("words"), F.lit(" "), F.lit(""))) + 1
        ).cast("long").alias("n_words"), "words"), "index-documents")


def phrases(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct phrases (_phrase, phrase, n) and their items (_phrase, item).

    A phrase is ``window`` consecutive words of an item, or all words of a shorter one.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             split_words(normal_words(F.col("text"))).alias("_words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - (window - 1), F.lit(1)))
    rows = items.filter(F.size("_words") > 0).select(
        "item", "_words", F.explode(starts).alias("_at")).select(
        "item", F.array_join(F.slice("_words", F.col("_at"), window), " ").alias("phrase"))
    both = stored(rows.distinct(), "index-phrases")
    distinct = stored(both.select("phrase").distinct().select(
        F.monotonically_increasing_id().alias("_phrase"), "phrase",
        F.size(F.split("phrase", " ")).alias("n")), "index-distinct")
    return distinct, stored(both.join(distinct, "phrase").select("_phrase", "item"), "index-items")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of ``terms`` occurs in all documents."""
    tokens = docs.select(F.explode(split_words(F.col("words"))).alias("term"))
    return stored(tokens.join(broadcast_if_small(terms), "term").groupBy("term").agg(
        F.count(F.lit(1)).alias("occurrences")), "index-counts")


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of ``terms``: (term, _row, position), 0-based."""
    tokens = docs.select("_row", F.posexplode(split_words(F.col("words"))).alias("position", "term"))
    return stored(tokens.join(broadcast_if_small(terms), "term").select("term", "_row", "position"),
                  "index-postings")


def rarest_terms(distinct: DataFrame, counts: DataFrame, lists: int = LISTS) -> DataFrame:
    """(_phrase, n, term, offset, lists): each phrase's rarest terms.

    A phrase with a term that no document has cannot occur and is left out.
    """
    places = distinct.select("_phrase", "n", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
    known = places.join(counts, "term", "left")
    each = Window.partitionBy("_phrase")
    return stored(
        known.withColumn("_dead", F.max(F.col("occurrences").isNull()).over(each))
        .filter(~F.col("_dead"))
        .withColumn("_place", F.row_number().over(each.orderBy("occurrences", "offset")))
        .filter(F.col("_place") <= lists)
        .select("_phrase", "n", "term", "offset", F.least("n", F.lit(lists)).alias("lists")), "index-rarest")


def phrase_candidates(index: DataFrame, rarest: DataFrame) -> DataFrame:
    """(_row, _phrase, start) where all of a phrase's rarest terms stand as in the phrase."""
    shifted = index.join(broadcast_if_small(rarest), "term").select(
        "_row", "_phrase", "lists", (F.col("position") - F.col("offset")).alias("start")).filter("start >= 0")
    return shifted.groupBy("_row", "_phrase", "start", "lists").agg(
        F.count(F.lit(1)).alias("_met")).filter("_met = lists").select("_row", "_phrase", "start")


def near_candidates(index: DataFrame, rarest: DataFrame, slop: int) -> DataFrame:
    """(_row, _phrase, start) where the rarest terms' shifted positions differ by ``slop`` at most."""
    shifted = index.join(broadcast_if_small(rarest), "term").select(
        "_row", "_phrase", "lists", "offset", (F.col("position") - F.col("offset")).alias("start"))
    width = slop + 1
    seated = shifted.select("*", F.explode(F.array(*[
        F.floor(F.col("start") / width) + d for d in (-1, 0, 1)])).alias("_cell"))
    home = F.floor(F.col("a.start") / width)
    pairs = shifted.alias("a").join(seated.alias("b"), (F.col("a._row") == F.col("b._row"))
                                    & (F.col("a._phrase") == F.col("b._phrase")) & (home == F.col("b._cell"))
                                    & (F.abs(F.col("a.start") - F.col("b.start")) <= slop))
    return pairs.groupBy("a._row", "a._phrase", "a.start", "a.lists").agg(
        F.count_distinct("b.offset").alias("_met")).filter("_met = lists").select("_row", "_phrase", "start")


def verified(docs: DataFrame, candidates: DataFrame, distinct: DataFrame, slop: int | None = None) -> DataFrame:
    """Every document with ``hits``, the candidates that hold: array of (start, n, _phrase).

    Without ``slop`` the phrase must stand there word for word. With it, all of its words
    must stand, in any order, at most ``slop`` places outside the phrase's own span.
    """
    shown = candidates.join(broadcast_if_small(distinct), "_phrase")
    per_row = shown.groupBy("_row").agg(
        F.collect_list(F.struct("start", "n", "_phrase", "phrase")).alias("_found"))

    def holds(words: Column, c: Column) -> Column:
        if slop is None:
            return F.array_join(F.slice(words, c["start"] + 1, c["n"]), " ") == c["phrase"]
        first = F.greatest(c["start"] - slop, F.lit(0))
        part = F.slice(words, first + 1, c["start"] + c["n"] + slop - first)
        return F.size(F.array_except(F.split(c["phrase"], " "), part)) == 0

    hits = F.when(F.col("_found").isNotNull(), let(
        split_words(F.col("words")), lambda words: F.filter("_found", lambda c: holds(words, c))))
    return docs.join(per_row, "_row", "left").select(
        *[c for c in docs.columns if c != "words"], F.transform(hits, lambda c: F.struct(
            c["start"].alias("start"), c["n"].alias("n"), c["_phrase"].alias("_phrase"))).alias("hits"))


def phrase_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None,
                   keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """Matches of the benchmark's phrases in ``docs``: (documents with hits, phrase items)."""
    numbered = numbered_documents(docs, keep)
    distinct, items = phrases(benchmark, window)
    terms = stored(distinct.select(F.explode(F.split("phrase", " ")).alias("term")).distinct(), "index-terms")
    rarest = rarest_terms(distinct, term_counts(numbered, terms))
    index = postings(numbered, stored(rarest.select("term").distinct(), "index-terms"))
    found = phrase_candidates(index, rarest) if slop is None else near_candidates(index, rarest, slop)
    return stored(verified(numbered, found, distinct, slop), "index-hits"), items


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words of each document that lie in a benchmark phrase, and the items they come from.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored.
    Null and wordless texts have no words and no phrases. Every row of ``docs`` gets a row,
    repeats included; repeated items count once. An item without an id is listed as an
    empty string. An empty benchmark contaminates nothing.
    """
    hits, items = phrase_matches(docs, benchmark, window)
    n_hit = F.size(F.array_distinct(F.flatten(F.transform(
        "hits", lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1)))))
    named = (hits.filter(F.size("hits") > 0)
             .select("_row", F.explode(F.array_distinct(F.transform("hits", lambda c: c["_phrase"]))).alias("_phrase"))
             .join(broadcast_if_small(items), "_phrase")
             .groupBy("_row").agg(F.sort_array(F.collect_set("item")).alias("_items")))
    rows = hits.withColumn("n_hit", F.coalesce(F.when(F.col("hits").isNotNull(), n_hit), F.lit(0)).cast("long"))
    return rows.drop("hits").join(named, "_row", "left").select(
        "doc_id", "n_words", "n_hit",
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no benchmark phrase occurs."""
    whole = docs.select(F.struct("*").alias("_doc"), "text", F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    hits, _ = phrase_matches(whole, benchmark, window, keep=("_id", "_hash"))
    bad = hits.filter(F.size("hits") > 0).select(F.col("_id").alias("bad_id"), F.col("_hash").alias("bad_hash")).distinct()
    on = (F.col("_hash") == F.col("bad_hash")) & F.col("_id").eqNullSafe(F.col("bad_id"))
    return whole.drop("text").join(bad, on, "left_anti").select("_doc.*")


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
_ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
phr AS (
  SELECT DISTINCT item, p, least(len(w), {WINDOW}) AS n FROM (
    SELECT item, w, unnest(list_transform(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS p
    FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM phr),
starts AS (
  SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM d, sizes WHERE len(w) >= n),
grams AS (SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS p FROM starts),
hit AS (SELECT g.rid, g.s, g.n, h.item FROM grams g JOIN phr h ON g.p = h.p AND g.n = h.n),
covered AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS x FROM (SELECT DISTINCT rid, s, n FROM hit)) GROUP BY rid),
named AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
       sha256(coalesce(m.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (rid) LEFT JOIN named m USING (rid)
"""


@query("op3_decontamination", _ORACLE)
def op3(t):
    return contamination(t.documents, t.benchmark)
