"""Grouped evaluation: leak-free folds, ranking scores, intervals, calibration, selection.

The subject (group) is the independent unit everywhere. Curves over score thresholds are
built from counts per distinct score and running sums, never from one sorted pile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograin.functions.numeric import portable_hash, ratio, replicate_counts, replicate_start, resampled
from tempograin.operators.ordered import Index, RunningSum, cut, join_same, quantiles
from tempograin.session import durable

# The seeds and the number of folds of the protocol.
SEEDS = [11, 23, 37, 53, 71]
N_FOLDS = 5


# ------------------------------------------------------------------------------- folds

def assign_folds(df: DataFrame, group: str, label: str, seeds: list[int] | None = None,
                 n_folds: int = N_FOLDS) -> DataFrame:
    """(seed, group, fold): each group in one test fold per seed, strata dealt in turn.

    Strata are the group's label mix and size class; inside a stratum groups are dealt
    to folds in the order of a seeded hash.
    """
    per = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label)).alias("_pos"))
    mix = F.when(F.col("_pos") == 0, 0).when(F.col("_pos") == F.col("_n"), 2).otherwise(1)
    strata = per.select(group, mix.alias("_mix"), F.floor(F.log2("_n")).cast("int").alias("_size"),
                        F.explode(F.array(*[F.lit(s) for s in seeds or SEEDS])).alias("seed"))
    hashed = strata.withColumn("_h", portable_hash(F.col("seed"), F.col(group)))
    dealt = cut(hashed, ["seed", "_mix", "_size"], ["_h", group]).add(_i=Index()).rows()
    return dealt.select("seed", group, (F.col("_i") % n_folds).cast("int").alias("fold"))


def fold_roles(assigned: DataFrame, n_folds: int = N_FOLDS) -> DataFrame:
    """(seed, fold, group, role) with role 'test' once and 'train' in the other folds."""
    rest = [c for c in assigned.columns if c != "fold"]
    return assigned.select(*rest, F.col("fold").alias("_own"), F.explode(F.array(*[
        F.lit(k) for k in range(n_folds)])).alias("fold")).select(
        *rest, "fold", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train").alias("role"))


def leave_one_wave_out(df: DataFrame, group: str, wave: str, label: str, min_rows: int = 20) -> DataFrame:
    """(fold wave, group, own wave, role); waves with one class or few rows are skipped.

    A group seen in the held-out wave is dropped from that fold's training side.
    """
    good = (df.filter(F.col(wave).isNotNull()).groupBy(wave)
            .agg(F.count(F.lit(1)).alias("_n"), F.min(label).alias("_lo"), F.max(label).alias("_hi"))
            .filter((F.col("_n") >= min_rows) & (F.col("_lo") != F.col("_hi"))).select(F.col(wave).alias("fold")))
    waves = df.filter(F.col(wave).isNotNull()).groupBy(group, wave).agg(F.count(F.lit(1)).alias("n"))
    test = waves.join(good, F.col("fold") == F.col(wave)).select("fold", group, wave, "n", F.lit("test").alias("role"))
    # Waves are a handful of years: their list is collected, the groups are not.
    folds = F.array_sort(F.collect_set("fold"))
    every = waves.withColumn("fold", F.explode(good.agg(folds).scalar()))
    train = (every.filter(F.col("fold") != F.col(wave))
             .join(test.select("fold", group).distinct(), ["fold", group], "left_anti")
             .select("fold", group, wave, "n", F.lit("train").alias("role")))
    return test.unionByName(train)


# ------------------------------------------------------------------------ score curves

def score_counts(df: DataFrame, keys: list[str], label: str, score: str, weight: Column | None = None) -> DataFrame:
    """Positives and negatives at each distinct score."""
    w = F.lit(1) if weight is None else weight
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("neg"))


def auc_from_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Tie-aware area under the ROC curve; NULL with a single class."""
    run = cut(counts, keys, ["score"]).add(_below=RunningSum(F.col("neg"))).rows()
    won = F.sum(F.col("pos") * (F.col("_below") - F.col("neg") + F.col("neg") / F.lit(2.0)))
    sides = [F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), won.alias("_won")]
    out = run.groupBy(*keys).agg(*sides) if keys else run.agg(*sides)
    return out.select(*keys, "n_pos", "n_neg",
                      ratio(F.col("_won"), F.col("n_pos") * F.col("n_neg")).alias("auc"))


def auc(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    return auc_from_counts(score_counts(df, keys, label, score), keys)


def _from_the_top(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative positives and negatives at or above each score, and the totals."""
    falling = counts.withColumn("_down", -F.col("score"))
    run = cut(falling, keys, ["_down"]).add(tp=RunningSum(F.col("pos")), fp=RunningSum(F.col("neg"))).rows()
    sums = [F.sum("pos").alias("_p"), F.sum("neg").alias("_q")]
    if keys:
        return join_same(run, counts.groupBy(*keys).agg(*sums), keys)
    return run.withColumns({"_p": counts.agg(sums[0]).scalar(), "_q": counts.agg(sums[1]).scalar()})


def average_precision(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Step-wise average precision, tied scores taken together."""
    top = _from_the_top(score_counts(df, keys, label, score), keys)
    step = (F.col("pos") / F.nullif(F.col("_p"), F.lit(0))) * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return top.groupBy(*keys).agg(F.sum(step).alias("ap")) if keys else top.agg(F.sum(step).alias("ap"))


def operating_points(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Youden, specificity 0.90, sensitivity 0.90 and threshold 0.50, with PPV and NPV.

    The curve starts at an infinite threshold (NULL here) that calls nothing positive.
    Ties go to the higher threshold.
    """
    top = _from_the_top(score_counts(df, keys, label, score), keys)
    curve = top.select(*keys, F.col("score").alias("threshold"), (F.col("tp") / F.col("_p")).alias("se"),
                       (1 - F.col("fp") / F.col("_q")).alias("sp"),
                       (F.col("_p") / (F.col("_p") + F.col("_q"))).alias("prevalence"))
    start = curve.select(*keys, "prevalence").distinct().select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("se"), F.lit(1.0).alias("sp"), "prevalence")
    rows = curve.unionByName(start)
    height = F.coalesce("threshold", F.lit(float("inf")))

    def best(value: Column) -> Column:
        return F.max(F.struct(F.round(value, 9).alias("v"), height.alias("h"), "threshold", "se", "sp", "prevalence"))
    picks = {
        "youden": best(F.col("se") + F.col("sp") - 1),
        "specificity 0.90": best(-F.abs(F.col("sp") - 0.90)),
        "sensitivity 0.90": best(-F.abs(F.col("se") - 0.90)),
        "threshold 0.50": F.max(F.when(F.col("threshold").isNotNull(), F.struct(
            F.round(-F.abs(F.col("threshold") - 0.50), 9).alias("v"), height.alias("h"), "threshold", "se", "sp", "prevalence")))}
    named = [v.alias(f"_{i}") for i, v in enumerate(picks.values())]
    chosen = rows.groupBy(*keys).agg(*named) if keys else rows.agg(*named)
    listed = F.array(*[F.struct(F.lit(n).alias("point"), F.col(f"_{i}").alias("at")) for i, n in enumerate(picks)])
    flat = chosen.select(*keys, F.inline(listed)).select(*keys, "point", "at.threshold", "at.se", "at.sp", "at.prevalence")
    p, se, sp = F.col("prevalence"), F.col("se"), F.col("sp")
    return flat.select(
        *keys, "point", "threshold", se.alias("sensitivity"), sp.alias("specificity"),
        (se * p / F.greatest(se * p + (1 - sp) * (1 - p), F.lit(1e-9))).alias("ppv"),
        (sp * (1 - p) / F.greatest(sp * (1 - p) + (1 - se) * p, F.lit(1e-9))).alias("npv"),
        ((se + sp) / 2).alias("balanced_accuracy"))


# ---------------------------------------------------------------------------- calibration

def brier(df: DataFrame, label: str, score: str) -> DataFrame:
    y, p = F.col(label).cast("double"), F.col(score)
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg((p - y) * (p - y)).alias("brier"),
                  (F.avg(y) * (1 - F.avg(y))).alias("brier_baseline"))


def reliability_bins(df: DataFrame, label: str, score: str, bins: int = 5) -> DataFrame:
    """Mean score and observed rate in quantile bins, each closed below."""
    edges = quantiles(df, [], score, {f"e{i}": i / bins for i in range(1, bins)})
    which = F.lit(0)
    for i in range(1, bins):
        which = which + (F.col(score) >= edges.select(f"e{i}").scalar()).cast("int")
    return df.withColumn("bin", which).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_pred"), F.avg(F.col(label).cast("double")).alias("observed"))


# ---------------------------------------------------------------------- folds summarised

def percentile_interval(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and the 2.5-97.5 percentile interval across the rows (folds) of a key."""
    q = quantiles(df, keys, value, {"lo": 0.025, "hi": 0.975})
    if not keys:
        return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean")).withColumns(
            {c: q.select(c).scalar() for c in ("lo", "hi")})
    return join_same(df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean")), q, keys)


def paired_fold_delta(a: DataFrame, b: DataFrame, folds: list[str], value: str) -> DataFrame:
    """a minus b fold by fold; raises when the two were scored on different folds."""
    both = a.select(*folds, F.col(value).alias("_a")).join(b.select(*folds, F.col(value).alias("_b")), folds, "full")
    delta = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(
        F.lit("models were not scored on the same folds")).cast("double")).otherwise(F.col("_a") - F.col("_b"))
    d = both.select(delta.alias("_d"))
    q = quantiles(d, [], "_d", {"lo": 0.025, "hi": 0.975})
    out = d.agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("delta"), F.count_if(F.col("_d") > 0).alias("wins"))
    return (out.withColumns({c: q.select(c).scalar() for c in ("lo", "hi")})
            .withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0)))


def out_of_fold(scores: DataFrame, row: str, score: str, all_rows: DataFrame) -> DataFrame:
    """Mean held-out score per row; raises for a row that was never held out."""
    per = scores.groupBy(row).agg(F.avg(score).alias("oof"), F.count(F.lit(1)).alias("n"))
    checked = F.when(F.col("n").isNull(), F.raise_error(F.lit("a row was never held out")).cast("double"))
    return all_rows.select(row).join(per, row, "left").select(row, checked.otherwise(F.col("oof")).alias("oof"), "n")


# ------------------------------------------------------------------------------ bootstrap

def spread_out(df: DataFrame) -> DataFrame:
    """``df`` over all tasks: each row is about to become one per replicate.

    An explicit count keeps adaptive execution from merging the partitions again.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *df.columns)


def bootstrap_mean(per_subject: DataFrame, keys: list[str], subject: str, value: str, reps: int = 2000,
                   seed: int = 11) -> DataFrame:
    """Mean over subjects with a percentile interval from resampled subjects.

    The interval is NULL below two subjects.
    """
    known = per_subject.filter(F.col(value).isNotNull()).select(*keys, subject, value)
    # One row per replicate: written once, since several summaries read it.
    means = durable(resampled(spread_out(known), [*keys, subject], reps, seed).groupBy(*keys, "rep")
                    .agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("_m")))
    q = quantiles(means, keys, "_m", {"lo": 0.025, "hi": 0.975})
    head = [F.count(F.lit(1)).alias("n_subjects"), F.avg(value).alias("mean")]
    if keys:
        out = join_same(known.groupBy(*keys).agg(*head), q, keys, "left")
    else:
        out = known.agg(*head).withColumns({c: q.select(c).scalar() for c in ("lo", "hi")})
    return out.withColumns({c: F.when(F.col("n_subjects") >= 2, F.col(c)) for c in ("lo", "hi")})


def _range_sums(rows: DataFrame, label: str, reps: int) -> DataFrame:
    """(range, rep, pos, neg, won) of each partition's rows (range, score, label, start, k), sorted by range and score.

    ``won`` counts the pairs inside the range in which the positive has the higher score.
    A few vectors of ``reps`` numbers are all the state.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = last = None
        pos, neg, won, tied_pos, tied_neg = np.zeros((5, reps))

        def close_score():
            won[:] += tied_pos * (neg + tied_neg / 2)
            pos[:] += tied_pos
            neg[:] += tied_neg
            tied_pos[:] = tied_neg[:] = 0

        def close_range():
            close_score()
            out = pd.DataFrame({"_range": at, "rep": np.arange(1, reps + 1), "pos": pos, "neg": neg, "_won": won})
            pos[:] = neg[:] = won[:] = 0
            return out
        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.iloc[first:first + 512]
                ranges, scores = part["_range"].to_numpy(), part["score"].fillna(np.inf).to_numpy()
                counts = replicate_counts(part["_x"].to_numpy(), reps) * part["_k"].to_numpy()[:, None]
                up, down = (part[label] == 1).to_numpy(), (part[label] == 0).to_numpy()
                new = np.flatnonzero((ranges[1:] != ranges[:-1]) | (scores[1:] != scores[:-1])) + 1
                for i, j in zip([0, *new], [*new, len(part)]):
                    if at is not None and ranges[i] != at:
                        yield close_range()
                    elif scores[i] != last:
                        close_score()
                    at, last = ranges[i], scores[i]
                    tied_pos += counts[i:j][up[i:j]].sum(axis=0)
                    tied_neg += counts[i:j][down[i:j]].sum(axis=0)
        if at is not None:
            yield close_range()
    return rows.select("_range", "score", label, "_x", "_k").mapInPandas(
        run, "_range double, rep int, pos double, neg double, _won double")


def in_ranges(rows: DataFrame, value: str, ranges: int) -> tuple[DataFrame, Column, list[float]]:
    """``rows`` with ``_range``, ascending in ``value``, whether a value is a range of its own, and those that are.

    Values spread over two borders or more are ranges of their own: their rows need no order.
    """
    borders = rows.approxQuantile(value, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    shared = sorted({a for a, b in zip(borders, borders[1:]) if a == b})
    splits = [float("-inf"), *sorted(set(borders)), float("inf")]
    if len(splits) > 2:
        placed = Bucketizer(splits=splits, inputCol=value, outputCol="_range", handleInvalid="keep").transform(rows)
    else:
        placed = rows.withColumn("_range", F.lit(0.0))
    # A shared value is its range's lower border.
    is_shared = F.col(value).isin(shared)
    return placed.withColumn("_range", 2 * F.col("_range") + F.when(is_shared, 0).otherwise(1)), is_shared, shared


def bootstrap_auc(df: DataFrame, subject: str, label: str, score: str, reps: int, seed: int,
                  min_kept: int = 100) -> DataFrame:
    """Interval of the AUC over resampled subjects; single-class replicates are skipped.

    Rows are shuffled once, by ranges of the score, and become replicates inside their
    range's task; a range hands on three sums per replicate. A score that many rows share
    is a range of its own, whose rows stay spread out, since it needs no order. Rows without
    a score are left out.
    """
    known = df.filter(F.col(score).isNotNull()).withColumn("score", F.col(score).cast("double"))
    rows = durable(known.groupBy(subject, label, "score").agg(F.count(F.lit(1)).alias("_k"))
                   .withColumn("_x", replicate_start([subject], seed)))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * tasks
    placed, is_shared, shared = in_ranges(rows, "score", ranges)
    pos, neg = F.col("pos"), F.col("neg")
    sums = [F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("_won").alias("_won")]
    ranged = _range_sums(placed.filter(~is_shared).repartition(tasks, "_range")
                         .sortWithinPartitions("_range", "score"), label, reps)
    if shared:
        tied = _range_sums(spread_out(placed.filter(is_shared)).sortWithinPartitions("_range"), label, reps)
        ranged = ranged.unionByName(tied.groupBy("_range", "rep").agg(*sums).withColumn("_won", pos * neg / 2))
    ranged = durable(ranged)
    lower = Window.partitionBy("rep").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("_won") + pos * F.coalesce(F.sum("neg").over(lower), F.lit(0))
    per_rep = ranged.withColumn("_won", won).groupBy("rep").agg(*sums)
    kept = durable(per_rep.select(ratio(F.col("_won"), pos * neg).alias("auc")).filter("auc is not null"))
    q = quantiles(kept, [], "auc", {"lo": 0.025, "hi": 0.975})
    # One subject alone cannot be resampled.
    several = F.coalesce(rows.agg(F.min(subject) < F.max(subject)).scalar(), F.lit(False))
    out = kept.agg(F.count(F.lit(1)).alias("n_kept")).withColumn("n_kept", F.when(several, F.col("n_kept")).otherwise(0))
    return out.withColumns({c: F.when(F.col("n_kept") >= min_kept, q.select(c).scalar()) for c in ("lo", "hi")})


def unpaired_difference(per_subject: DataFrame, arm: str, first: str, second: str, subject: str, value: str,
                        reps: int, seed: int) -> DataFrame:
    """Mean of one arm minus the other, each side's subjects resampled on their own.

    The interval is NULL where a side has fewer than two subjects.
    """
    known = per_subject.filter(F.col(value).isNotNull())
    means = (resampled(spread_out(known.select(arm, subject, value)), [arm, subject], reps, seed)
             .groupBy("rep", arm).agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("_m")))
    per_rep = durable(means.groupBy("rep").agg(
        (F.max(F.when(F.col(arm) == second, F.col("_m"))) - F.max(F.when(F.col(arm) == first, F.col("_m")))).alias("_d")))
    q = quantiles(per_rep, [], "_d", {"lo": 0.025, "hi": 0.975})
    point = F.avg(F.when(F.col(arm) == second, F.col(value))) - F.avg(F.when(F.col(arm) == first, F.col(value)))
    least = F.least(*[F.count_if(F.col(arm) == a) for a in (first, second)])
    out = known.agg(point.alias("difference"), least.alias("_least"))
    return out.withColumns({c: F.when(F.col("_least") >= 2, q.select(c).scalar()) for c in ("lo", "hi")}).drop("_least")


def paired_penalty(scores: DataFrame, clip: list[str], subject: str, arm: str, base: str, other: str, value: str,
                   reps: int, seed: int) -> DataFrame:
    """Other minus base per subject over clips both arms scored, with a subject interval."""
    wide = scores.groupBy(*clip, subject).agg(
        F.max(F.when(F.col(arm) == base, F.col(value))).alias("_a"),
        F.max(F.when(F.col(arm) == other, F.col(value))).alias("_b"))
    per = durable(wide.filter("_a is not null and _b is not null").groupBy(subject)
                  .agg((F.avg("_b") - F.avg("_a")).alias("penalty")))
    out = bootstrap_mean(per, [], subject, "penalty", reps, seed)
    return out.withColumnRenamed("mean", "penalty").withColumn("resolved", (F.col("lo") > 0) | (F.col("hi") < 0))


# ------------------------------------------------------------- repeats and selectivity

def repeat_agreement(df: DataFrame, subject: str, label: str, score: str, order: str) -> DataFrame:
    """Agreement over all unordered pairs of one subject's rows, without making the pairs.

    With rows ranked by score, the sum of |difference| over pairs is a weighted sum; with
    rows in ``order``, products and squares over pairs follow from running totals. So
    every pair statistic is a per-subject sum and long subjects cost linear time.
    """
    per = df.groupBy(subject).agg(F.count(F.lit(1)).alias("_n"), F.min(label).alias("_lo"), F.max(label).alias("_hi"))
    multi = per.filter("_n >= 2")
    same = multi.filter("_lo = _hi").select(subject, "_n")
    rows = df.join(same, subject).select(subject, "_n", F.col(score).alias("_p"), F.col(order).alias("_o"))
    by_score = cut(rows, [subject], ["_p", "_o"]).add(_i=Index())
    placed = cut(by_score.rows(), [subject], ["_o"]).add(_k=Index()).rows()
    n, i, k, p = F.col("_n"), F.col("_i"), F.col("_k"), F.col("_p")
    after, before = n - 1 - k, k
    sums = placed.groupBy(subject).agg(
        F.max("_n").alias("n"), F.count_if(p > 0.5).alias("_up"),
        F.sum((2 * i - n + 1) * p).alias("_gap"), F.sum(p).alias("_s"), F.sum(p * p).alias("_ss"),
        F.sum(p * after).alias("_x"), F.sum(p * before).alias("_y"),
        F.sum(p * p * after).alias("_xx"), F.sum(p * p * before).alias("_yy"))
    m, up = F.col("n"), F.col("_up")
    pairs = m * (m - 1) / 2.0
    agree = (up * (up - 1) + (m - up) * (m - up - 1)) / 2.0
    return sums.select(subject, pairs.cast("long").alias("n_pairs"), agree.cast("long").alias("n_agree"),
                       F.col("_gap").alias("sum_abs_diff"), "_x", "_y", "_xx", "_yy",
                       ((F.col("_s") * F.col("_s") - F.col("_ss")) / 2.0).alias("_xy"))


def repeat_summary(per_subject: DataFrame, df: DataFrame, subject: str) -> DataFrame:
    """Pair agreement, score correlation over ordered pairs and mean |difference|."""
    n = F.sum("n_pairs")
    mx, my = F.sum("_x") / n, F.sum("_y") / n
    cov = F.sum("_xy") / n - mx * my
    sx = F.sqrt(F.greatest(F.sum("_xx") / n - mx * mx, F.lit(0.0)))
    sy = F.sqrt(F.greatest(F.sum("_yy") / n - my * my, F.lit(0.0)))
    multi = (df.groupBy(subject).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").agg(F.count(F.lit(1)))).scalar()
    return per_subject.agg(
        F.count(F.lit(1)).alias("n_subjects_same_side"), n.alias("n_session_pairs"),
        (F.sum("n_agree") / n).alias("binary_agreement"), F.when(n > 2, ratio(cov, sx * sy)).alias("score_corr"),
        (F.sum("sum_abs_diff") / n).alias("mean_abs_score_diff")).withColumn("n_subjects_multi_session", multi)


def most_confident(df: DataFrame, fold: list[str], score: str, row: str, coverages: list[float]) -> DataFrame:
    """Rows kept at each coverage: the most confident share of every fold, at least two.

    Counts per distinct confidence give the value at which each coverage ends; only rows with that value are ranked.
    """
    ranked = df.withColumn("_unsure", F.coalesce(-F.round(F.abs(F.col(score) - 0.5), 9).cast("double"), F.lit(float("-inf"))))
    counts = durable(ranked.groupBy(*fold, "_unsure").agg(F.count(F.lit(1)).alias("_n")))
    cum = cut(counts, fold, ["_unsure"]).add(_cum=RunningSum(F.col("_n"))).rows()
    sizes = counts.groupBy(*fold).agg(F.sum("_n").alias("_size"))
    each = join_same(cum, sizes, fold).withColumn("coverage", F.explode(F.array(*[F.lit(c) for c in coverages])))
    keep = F.greatest(F.lit(2), F.rint(F.round(F.col("coverage") * F.col("_size"), 6)).cast("long"))
    # The value with which a coverage ends (the last one where there are fewer rows), and how many rows with it are kept.
    before = F.col("_cum") - F.col("_n")
    ends = each.withColumn("_keep", keep).filter((before < F.col("_keep")) & (F.least("_keep", "_size") <= F.col("_cum"))).select(
        *fold, F.struct("coverage", F.col("_unsure").alias("end"), (F.col("_keep") - before).alias("room")).alias("_end"))
    per_fold = durable(ends.groupBy(*fold).agg(F.collect_list("_end").alias("_ends")))
    levels = join_same(ranked, per_fold, fold)
    above = levels.withColumn("coverage", F.explode(F.transform(
        F.filter("_ends", lambda e: F.col("_unsure") < e["end"]), lambda e: e["coverage"])))
    tied = levels.withColumn("_ends", F.filter("_ends", lambda e: F.col("_unsure") == e["end"])).filter(F.size("_ends") > 0)
    placed = cut(tied, [*fold, "_unsure"], [row]).add(_i=Index()).rows()
    last = placed.withColumn("coverage", F.explode(F.transform(
        F.filter("_ends", lambda e: F.col("_i") < e["room"]), lambda e: e["coverage"])))
    return above.drop("_ends", "_unsure").unionByName(last.drop("_ends", "_unsure", "_i"))


def selective_curve(df: DataFrame, fold: list[str], label: str, score: str, row: str, coverages: list[float]) -> DataFrame:
    """Accuracy, balanced accuracy and AUC among the most confident rows, over folds."""
    kept = most_confident(df, fold, score, row, coverages)
    call = (F.col(score) > 0.5).cast("int")
    right = (call == F.col(label)).cast("double")
    cell = [*fold, "coverage"]
    per = kept.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("_pos"), F.avg(right).alias("acc"),
        ((F.avg(F.when(F.col(label) == 1, right)) + F.avg(F.when(F.col(label) == 0, right))) / 2).alias("bal"))
    joined = per.join(auc(kept, cell, label, score).select(*cell, "auc"), cell)
    return joined.groupBy("coverage").agg(
        F.avg("n").alias("mean_kept"), F.avg("acc").alias("accuracy"), F.avg("bal").alias("balanced_accuracy"),
        F.avg("auc").alias("auc_on_kept"), (F.sum("_pos") / F.sum("n")).alias("base_rate"))


def averaging_gain(df: DataFrame, subject: str, label: str, score: str) -> DataFrame:
    """Accuracy of single rows against the subject's mean score, repeat subjects only."""
    per = df.groupBy(subject).agg(
        F.count(F.lit(1)).alias("n"), F.min(label).alias("y"), F.max(label).alias("_hi"), F.avg(score).alias("p"),
        F.count_if((F.col(score) > 0.5).cast("int") == F.col(label)).alias("_right"))
    kept = per.filter("n >= 2 and y = _hi")
    averaged = ((F.round("p", 9) > 0.5).cast("int") == F.col("y")).cast("double")
    out = kept.agg(F.count(F.lit(1)).alias("n_subjects"), F.sum("n").alias("n_rows"),
                   (F.sum("_right") / F.sum("n")).alias("single_accuracy"), F.avg(averaged).alias("averaged_accuracy"))
    return out.withColumn("gain", F.col("averaged_accuracy") - F.col("single_accuracy"))


def control_gate(controls: DataFrame, bar: float, strict: bool = False) -> DataFrame:
    """Largest distance of a negative control's mean AUC from chance, against the bar."""
    worst = F.max_by(F.struct("name", F.abs(F.col("auc") - 0.5).alias("d")), F.round(F.abs(F.col("auc") - 0.5), 9))
    out = controls.agg(worst.alias("_w")).select(F.col("_w")["name"].alias("worst"), F.col("_w")["d"].alias("deviation"))
    ok = F.col("deviation") < bar
    return out.withColumn("passed", F.when(ok, True).otherwise(
        F.raise_error(F.lit("a negative control is not at chance")).cast("boolean")) if strict else ok)
