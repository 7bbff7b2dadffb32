"""Quality rules on how far a document's histograms lie from its language's.

Two histograms are compared with the language's own by Jensen-Shannon distance: character
classes and common words. Documents below a minimum length are not judged by them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograin.llm.common import let, query, same, stored

GAP = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"
REPEAT = 8
CLASSES = ["n_lower", "n_space", "n_upper", "n_digit", "n_mark", "n_other"]
# Frequent function words of each language with a reference.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "are", "as", "with", "be", "by"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "dans", "pour", "par", "sur"],
    "de": ["der", "die", "das", "und", "in", "den", "von", "zu", "mit", "ist", "nicht", "ein", "eine", "sich", "auf", "im"],
    "es": ["el", "la", "los", "de", "en", "y", "que", "un", "una", "las", "por", "con", "para", "del", "se", "no"],
}
LETTERS = "abcdefghijklmnop"  # the code of each common word of a list
MIN_CHARS = 200
MIN_WORDS = 60
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.45


def text_statistics(docs: DataFrame) -> DataFrame:
    """Counts per document; ``_codes`` has a letter per word, a dot for uncommon ones."""
    text = F.coalesce(F.col("text"), F.lit(""))
    chain = docs.select("doc_id", "lang", text.alias("_text"))
    steps = {"n_lower": r"\p{Ll}+", "n_space": GAP, "n_upper": r"\p{Lu}+", "n_digit": r"\p{Nd}+",
             "n_mark": r"[!-/:-@\[-`{-~]+"}
    left = "_text"
    for i, (name, pattern) in enumerate(steps.items()):
        chain = chain.withColumn(f"_left{i}", F.regexp_replace(left, pattern, "")).withColumn(
            name, (F.length(left) - F.length(f"_left{i}")).cast("long"))
        left = f"_left{i}"
    symbols = F.length("_left1") - F.length(F.translate("_left1", SYMBOLS, ""))
    words = F.filter(F.split("_text", GAP), lambda w: w != "")
    lines = F.filter(F.split("_text", "\n"), lambda s: s.rlike(r"[^ \t-\r]"))
    return chain.select(
        "doc_id", "lang", *CLASSES[:-1], F.length(left).cast("long").alias("n_other"),
        (F.length("_text") - F.col("n_space")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words, lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            _codes(w, F.col("lang")).alias("codes"))).alias("_w"),
    ).select("*", "_w.n_words", "_w.n_repeat_words", F.col("_w.codes").alias("_codes")).drop("_w")


def repeated_words(words: Column, length: int = REPEAT) -> Column:
    """How many of ``words`` lie in a window of eight that the text has twice or more.

    Windows are compared by a 64-bit hash, built by doubling: 1, 2, 4, 8 words. Only texts
    in which a hash repeats are sorted to find where.
    """
    def doubling(by):
        def doubled(h):
            return F.zip_with(h, F.slice(h, by + 1, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))
        return doubled
    by, hashes = 1, F.transform(words, lambda w: F.xxhash64(w))
    while by < length:
        hashes = let(hashes, doubling(by))
        by *= 2
    windows = F.slice(hashes, 1, F.greatest(F.size(words) - (length - 1), F.lit(0)))

    def twice(h):
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(placed, lambda s: F.array_sort(F.transform(
            F.filter(s, lambda x, i: (same(x["h"], F.get(s, i - 1)["h"])) | (same(x["h"], F.get(s, i + 1)["h"]))),
            lambda x: x["i"])))

    def covered(places):
        start = F.struct(F.lit(-length).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, start, lambda s, p: F.struct(
            p.alias("last"), (s["n"] + F.least(p - s["last"], F.lit(length))).cast("long").alias("n")), lambda s: s["n"])
    return let(windows, lambda h: F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0).cast("long"))
               .otherwise(covered(twice(h))))


def _codes(words: Column, lang: Column) -> Column:
    table = None
    for name, common in COMMON_WORDS.items():
        listed = F.array(*[F.lit(w) for w in common])
        table = F.when(lang == name, listed) if table is None else table.when(lang == name, listed)
    return let(table, lambda t: F.when(t.isNull(), F.lit("")).otherwise(F.array_join(F.transform(
        words, lambda w: F.substr(F.lit("." + LETTERS), (F.array_position(t, F.lower(w)) + 1).cast("int"), F.lit(1))), "")))


def js_distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of an array of counts to shares that sum to one."""
    def gain(x, m):
        return F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)

    def distance(s):
        terms = F.zip_with(s["counts"], s["shares"], lambda c, q: let(
            F.struct((c / s["total"]).alias("p"), q.alias("q"), ((c / s["total"] + q) / 2).alias("m")),
            lambda t: gain(t["p"], t["m"]) + gain(t["q"], t["m"])))
        return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / (2 * math.log(2)), F.lit(0.0)))
    total = F.greatest(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1)).cast("double")
    return let(F.struct(counts.alias("counts"), reference.alias("shares"), total.alias("total")), distance)


def judge(docs: DataFrame, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Rule counts, distances and verdict for every row of ``docs`` (doc_id, text, lang).

    The references are the pooled histograms of all documents of a language that pass the
    base rules; languages without a word list share one reference of character classes and
    are not judged by words. Texts of under ``MIN_CHARS`` characters are not judged by
    classes and those of under ``MIN_WORDS`` words not by words. Null texts count as
    empty, a null language as one without a list. Repeated rows are judged each.
    """
    def count(code):
        return F.length("_codes") - F.length(F.replace(F.col("_codes"), code, F.lit("")))
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    common = F.transform(F.array(*[F.lit(c) for c in LETTERS]), lambda c: count(c).cast("long"))
    uncommon = (F.length("_codes") - F.aggregate("_common", F.lit(0).cast("long"), lambda a, x: a + x)).cast("long")
    rows = stored(text_statistics(docs).select(
        "*", F.array(*CLASSES).alias("_classes"), common.alias("_common"), base_failed.alias("base_failed"),
        F.when(F.col("lang").isin(list(COMMON_WORDS)), F.col("lang")).otherwise("").alias("_lang"))
        .withColumn("_words", F.concat("_common", F.array(uncommon))).drop("_codes", "_common", *CLASSES), "rules-counts")
    # One row for each language with a list, and one for all others.
    sizes = {"_classes": len(CLASSES), "_words": len(LETTERS) + 1}
    pooled = rows.filter(~F.col("base_failed")).groupBy("_lang").agg(
        *[F.sum(F.get(name, F.lit(i))).alias(f"{name}{i}") for name, n in sizes.items() for i in range(n)]).collect()

    def reference(name):
        out = F.lit(None).cast("array<double>")
        for r in pooled:
            shares = F.array(*[F.lit(x) for x in _shares([r[f"{name}{i}"] for i in range(sizes[name])])])
            out = F.when(F.col("_lang") == r["_lang"], shares).otherwise(out)
        return out
    n_chars = F.aggregate("_classes", F.lit(0).cast("long"), lambda a, x: a + x)
    by_class = js_distance(F.col("_classes"), reference("_classes"))
    by_word = js_distance(F.col("_words"), reference("_words"))
    measured = rows.select(
        "*", F.when(n_chars >= MIN_CHARS, by_class).alias("class_distance"),
        F.when((F.col("n_words") >= MIN_WORDS) & (F.col("_lang") != ""), by_word).alias("word_distance"))
    kept = (~F.col("base_failed") & (F.coalesce("class_distance", F.lit(0.0)) <= max_class)
            & (F.coalesce("word_distance", F.lit(0.0)) <= max_word))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           "base_failed", kept.alias("kept"), "class_distance", "word_distance")


def _shares(counts: list[int]) -> list[float]:
    total = max(1, sum(counts))
    return [c / total for c in counts]


@query("op7_divergence_rules")
def op7(t):
    return judge(t.documents)
