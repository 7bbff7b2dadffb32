"""Quality classifier: quadratic discriminant analysis with shrunk covariances.

Each class is a Gaussian over transformed statistics of the text. Its covariance is drawn
towards the pooled one, the more the fewer rows the class has, and a little towards a
sphere. The score comes from the difference of the two log densities, for which each
class's Cholesky factor is inverted once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograin.llm.common import let, query, stored

GAP = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>!"
FEATURES = ["f_words", "f_upper", "f_symbols", "f_digits", "f_length", "f_distinct"]
POOLED_ROWS = 40.0  # the weight of the pooled covariance, in rows
SPHERE = 0.02  # the share of the sphere
THRESHOLD = 0.3
FOLDS = 5


def text_features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep, features): logarithms of counts and shares, each drawn to a usual value in short texts."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def without(column, pattern):
        return F.length(column) - F.length(F.regexp_replace(column, pattern, ""))
    marks = F.regexp_replace("_text", r"[\p{L}\p{Nd} \t-\r]+", "")
    rows = docs.select(*keep, text.alias("_text")).select(
        *keep, "_text", marks.alias("_marks"),
        let(F.filter(F.split("_text", GAP), lambda w: w != ""), lambda w: F.struct(
            F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"))).alias("_w"))
    n, chars = F.col("_w.n"), F.length("_text")

    def share(count, usual):
        return F.log((count + 50 * usual) / (chars + 50.0))
    return rows.select(
        *keep,
        F.log1p(n.cast("double")).alias("f_words"),
        share(without("_text", r"\p{Lu}+"), 0.02).alias("f_upper"),
        share(F.length("_marks") - F.length(F.translate("_marks", SYMBOLS, "")), 0.005).alias("f_symbols"),
        share(without("_text", r"\p{Nd}+"), 0.005).alias("f_digits"),
        F.log((chars - without("_text", GAP) + 100.0) / (n + 20.0)).alias("f_length"),
        F.log((F.col("_w.distinct") + 20.0) / (n + 20.0)).alias("f_distinct"))


@dataclass(frozen=True)
class Discriminant:
    """A fitted classifier; ``factors`` are the inverted Cholesky factors of the two classes."""

    mean: np.ndarray
    scale: np.ndarray
    centres: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    constant: float | None = None

    def score(self) -> Column:
        """The probability of class 1 as an expression over the feature columns."""
        if self.constant is not None:
            return F.lit(float(self.constant))
        logit = F.lit(self.offsets[1] - self.offsets[0])
        z = [(F.col(f) - float(m)) / float(s) for f, m, s in zip(FEATURES, self.mean, self.scale)]
        for sign, centre, factor in zip((0.5, -0.5), self.centres, self.factors):
            for i, row in enumerate(factor):
                y = sum(((z[j] - float(centre[j])) * float(row[j]) for j in range(i + 1)), F.lit(0.0))
                logit = logit + sign * F.pow(y, F.lit(2.0))
        return 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(50.0)), F.lit(-50.0))))



def fit(rows: DataFrame) -> Discriminant:
    """Fit to (features, quality) by sums alone: one row per class comes to the driver.

    Sums are rounded, so that the order in which Spark adds them up does not show.
    """
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
    sums = {r["quality"]: r for r in rows.groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.sum(f), 5).alias(f) for f in FEATURES],
        *[F.round(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])), 5).alias(f"p{i}_{j}") for i, j in pairs]).collect()}
    d = len(FEATURES)
    if 0 not in sums or 1 not in sums:
        return Discriminant(np.zeros(d), np.ones(d), [], [], [], 1.0 if 1 in sums else 0.0 if 0 in sums else 0.5)
    counts = [sums[c]["n"] for c in (0, 1)]
    means = [np.array([sums[c][f] for f in FEATURES]) / n for c, n in zip((0, 1), counts)]
    spread = []
    for c, n, m in zip((0, 1), counts, means):
        gram = np.zeros((d, d))
        for i, j in pairs:
            gram[i, j] = gram[j, i] = sums[c][f"p{i}_{j}"]
        spread.append(gram / n - np.outer(m, m))
    total = sum(counts)
    mean = sum(n * m for n, m in zip(counts, means)) / total
    within = sum(n * s for n, s in zip(counts, spread)) / total
    scale = np.sqrt(np.maximum(np.diag(within) + sum(
        n * (m - mean) ** 2 for n, m in zip(counts, means)) / total, 1e-9))
    factors, offsets = [], []
    for n, s in zip(counts, spread):
        weight = POOLED_ROWS / (POOLED_ROWS + n)
        shrunk = ((1 - weight) * s + weight * within) / np.outer(scale, scale)
        shrunk = (1 - SPHERE) * shrunk + SPHERE * max(np.trace(shrunk) / d, 1e-3) * np.eye(d)
        root = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(root))
        offsets.append(float(np.log(n / total) - np.log(np.diag(root)).sum()))
    return Discriminant(mean, scale, [(m - mean) / scale for m in means], factors, offsets)


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are kept from the fit; a null id always is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _fit_on(features: DataFrame, labels: DataFrame) -> Discriminant:
    known = labels.filter(F.col("quality").isin(0, 1)).select(
        "doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    return fit(features.join(known, "doc_id").filter(~held_out(F.col("doc_id"))))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    ``labels`` has doc_id and quality; other qualities than 0 and 1 are ignored, repeats
    count once, contradicting labels of one id count for both classes. Null texts are
    scored as empty ones. With labels of one class alone every score is that class's, with
    none it is 0.5. Other columns are ignored.
    """
    rows = stored(text_features(docs), "quality-features")
    model = _fit_on(rows, labels)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score")).select(
        "*", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more."""
    model = _fit_on(text_features(docs), labels)
    whole = docs.select(F.struct("*").alias("_doc"), "text")
    return text_features(whole, ("_doc",)).filter(model.score() >= threshold).select("_doc.*")


@query("op6_quality_discriminant")
def op6(t):
    return score_documents(t.documents, t.labels)
