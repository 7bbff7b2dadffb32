"""Error tables: statistics per cell, subject-first means, stability, verdicts, choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograin.functions.numeric import correlation
from tempograin.operators.ordered import Index, cut, join_same, quantiles


def error_stats(df: DataFrame, keys: list[str], est: str, ref: str, min_rows: int = 5) -> DataFrame:
    """MAE, bias, SD (ddof 1), r and n per cell; all NULL below ``min_rows``, r NULL when flat."""
    known = df.filter(F.col(est).isNotNull() & F.col(ref).isNotNull())
    d = F.col(est) - F.col(ref)
    out = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"),
                                   F.stddev_samp(d).alias("sd"), correlation(F.col(ref), F.col(est)).alias("r"))
    return out.withColumns({c: F.when(F.col("n") >= min_rows, F.col(c)) for c in ("mae", "bias", "sd", "r")})


def decompose_error(df: DataFrame, keys: list[str], stride: str, error: Column) -> DataFrame:
    """Split error into what persists over strides and what averages out (ddof 0)."""
    per = df.filter(error.isNotNull()).groupBy(*keys, stride).agg(
        F.count(F.lit(1)).alias("_k"), F.avg(error).alias("_m"), F.stddev_pop(error).alias("_s"))
    out = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_strides"), F.stddev_pop("_m").alias("systematic_sd"),
                                 F.avg(F.when(F.col("_k") > 1, F.col("_s"))).alias("within_sd"))
    effective = F.sqrt(F.col("systematic_sd") * F.col("systematic_sd")
                       + F.col("within_sd") * F.col("within_sd") / F.greatest(F.col("n_strides"), F.lit(1)))
    return out.withColumn("effective_sigma", effective)


def subject_first(df: DataFrame, keys: list[str], subject: str, value: str) -> DataFrame:
    """Mean over subjects of each subject's mean, with the pooled mean kept beside it."""
    per = df.filter(F.col(value).isNotNull()).groupBy(*keys, subject).agg(
        F.avg(value).alias("_m"), F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_subjects"), F.avg("_m").alias("subject_mean"),
                                  F.stddev_samp("_m").alias("sd_across"), (F.sum("_s") / F.sum("_n")).alias("pooled_mean"),
                                  F.sum("_n").alias("n_rows"))


def complete_rows(df: DataFrame, keys: list[str], part: str, parts: list[str], value: str) -> DataFrame:
    """Mean over the named parts of each row, only for rows that have all of them."""
    wide = df.groupBy(*keys).agg(*[F.avg(F.when(F.col(part) == p, F.col(value))).alias(f"_{i}") for i, p in enumerate(parts)])
    total = sum((F.col(f"_{i}") for i in range(1, len(parts))), F.col("_0"))
    return wide.select(*keys, (total / len(parts)).alias(value)).filter(F.col(value).isNotNull())


def cv_percent(value: Column) -> Column:
    """100·sd/mean as an aggregate; NULL below two values or when one is not positive."""
    return F.when((F.count(value) >= 2) & (F.min(value) > 0), 100.0 * F.stddev_samp(value) / F.avg(value))


def cv_absolute(value: Column) -> Column:
    """|sd/mean| as an aggregate; NULL below two values or for a mean near zero."""
    mean = F.avg(value)
    return F.when((F.count(value) >= 2) & (F.abs(mean) >= 1e-12), F.abs(F.stddev_samp(value) / F.nullif(mean, F.lit(0.0))))


def stability(df: DataFrame, subject: str, trial: str, value: str) -> DataFrame:
    """CV over a subject's trials (median over cameras each) and over cameras in a trial."""
    cell = [subject, trial]
    known = df.filter(F.col(value).isNotNull())
    medians = quantiles(known, cell, value, {"_med": 0.5})
    cams = known.groupBy(*cell).agg(cv_percent(F.col(value)).alias("_cams"))
    per_subject = medians.groupBy(subject).agg(cv_percent(F.col("_med")).alias("_trials"))
    out = per_subject.agg(F.avg("_trials").alias("cv_across_trials"), F.count("_trials").alias("n_subjects"))
    return out.withColumn("cv_across_cameras", cams.agg(F.avg("_cams")).scalar())


def tri_state(value: Column, bar: float) -> Column:
    """Met, not met, or NULL: an undefined value is never a failure."""
    return F.when(value.isNull(), F.lit(None).cast("boolean")).otherwise(value <= bar)


def verdict_band(percent: Column, good: float = 3.0, usable: float = 8.0) -> Column:
    return F.when(percent <= good, "pass").when(percent <= usable, "usable").otherwise("fail")


def asymmetry_percent(left: Column, right: Column) -> Column:
    """|l - r| as a percent of their mean."""
    return 100.0 * F.abs(left - right) / F.nullif((left + right) / 2.0, F.lit(0.0))


def quartile_bins(df: DataFrame, ratio_column: str, value: str) -> DataFrame:
    """Size and median value in each quartile of a ratio; the last bin is closed."""
    edges = quantiles(df, [], ratio_column, {"e0": 0.0, "e1": 0.25, "e2": 0.5, "e3": 0.75, "e4": 1.0})
    cut_at = {c: edges.select(c).scalar() for c in ("e1", "e2", "e3")}
    which = sum(((F.col(ratio_column) >= e).cast("int") for e in cut_at.values()), F.lit(0))
    binned = df.withColumn("bin", which)
    sizes = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min(ratio_column).alias("lo"), F.max(ratio_column).alias("hi"))
    return sizes.join(quantiles(binned, ["bin"], value, {"median": 0.5}), "bin")


def duplicate_content(df: DataFrame, key: str, content: str) -> DataFrame:
    """Groups of byte-identical content with more than one member."""
    return (df.groupBy(F.md5(content).alias("digest"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_member"), F.max(key).alias("last_member"))
            .filter("n > 1"))


def without_duplicates(df: DataFrame, key: str, content: str) -> DataFrame:
    """Keys whose content occurs once; a duplicated group is dropped whole."""
    return (df.groupBy(F.md5(content).alias("_d")).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias(key))
            .filter("_n = 1").select(key))


def agreement(df: DataFrame, keys: list[str], nominal: Column, measured: Column) -> DataFrame:
    """n, mean, SD, mean error and median relative error per level."""
    rows = df.select(*keys, measured.alias("_m"), (measured - nominal).alias("_e"),
                     F.abs(100.0 * (measured - nominal) / nominal).alias("_rel"))
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("sd"),
                                    F.avg("_e").alias("mean_error"))
    return join_same(stats, quantiles(rows, keys, "_rel", {"median_rel": 0.5}), keys)


def worst_rows(df: DataFrame, error: Column, key: str, k: int) -> DataFrame:
    """The k rows with the largest absolute error: a bounded top-k, not a full sort."""
    return df.withColumn("_e", F.round(F.abs(error), 9)).orderBy(F.desc("_e"), key).limit(k).drop("_e")


def longest_first_sample(sizes: DataFrame, key: str, n: str, limit: int) -> DataFrame:
    """Half the longest clips, and an even stride through the rest."""
    ranked = cut(sizes.withColumn("_neg", -F.col(n)), [], ["_neg", key]).add(position=Index()).rows().drop("_neg")
    half = limit // 2
    total = sizes.agg(F.count(F.lit(1))).scalar()
    step = F.greatest(F.lit(1), F.floor((total - half) / max(limit - half, 1)))
    nth = F.floor((F.col("position") - half) / step)
    strided = ((F.col("position") - half) % step == 0) & (nth < limit - half)
    return ranked.filter((F.col("position") < half) | ((F.col("position") >= half) & strided))


def first_usable(df: DataFrame, keys: list[str], preferred: list[str]) -> DataFrame:
    """Per trial, the first column in preference order that is not all NULL."""
    counts = df.groupBy(*keys).agg(*[F.count(c).alias(f"_{i}") for i, c in enumerate(preferred)])
    pick = F.lit(None).cast("string")
    for i in range(len(preferred) - 1, -1, -1):
        pick = F.when(F.col(f"_{i}") > 0, preferred[i]).otherwise(pick)
    return counts.select(*keys, pick.alias("used"))


def arm_costs(df: DataFrame, keys: list[str], arm: str, base: str, value: str) -> DataFrame:
    """Each arm's mean minus the base arm's, per key."""
    means = df.groupBy(*keys, arm).agg(F.avg(value).alias("_v"))
    floor = means.filter(F.col(arm) == base).select(*keys, F.col("_v").alias("_b"))
    return (join_same(means.filter(F.col(arm) != base), floor, keys)
            .select(*keys, arm, F.col("_v").alias("value"), (F.col("_v") - F.col("_b")).alias("cost")))


def holds_on(per_subject: DataFrame, keys: list[str], rule: Column, required: int) -> DataFrame:
    """Whether a rule holds on at least ``required`` subjects."""
    ok = F.count_if(F.coalesce(rule, F.lit(False)))
    return per_subject.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), ok.alias("n_meeting"), (ok >= required).alias("supported"),
        F.bool_and(F.coalesce(rule, F.lit(False))).alias("all_meet"))


def hit_rate(df: DataFrame, keys: list[str], said: str, truth: str) -> DataFrame:
    """Agreement with abstentions as misses, and among confident answers only."""
    hit = (F.coalesce(F.col(said) == F.col(truth), F.lit(False))).cast("double")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(hit).alias("hit_rate"),
        F.avg(F.when(F.col(said).isNotNull(), hit)).alias("confident_rate"),
        F.count_if(F.col(said).isNull()).alias("n_abstained"))


def choose_candidate(stats: DataFrame, keys: list[str], name: str, mean: str, declared: str, band: float) -> DataFrame:
    """Candidate with the smallest |mean|; inside the tie band the declared one wins."""
    rows = stats.withColumn("_a", F.abs(mean))
    best = rows.groupBy(*keys).agg(F.min("_a").alias("_best"))
    near = join_same(rows, best, keys).withColumn("_near", F.col("_a") - F.col("_best") < band)
    out = near.groupBy(*keys).agg(
        F.min(F.struct(F.round("_a", 9).alias("a"), F.col(name).alias("c")))["c"].alias("_smallest"),
        F.count_if("_near").alias("_close"), F.max((F.col("_near") & (F.col(name) == declared)).cast("int")).alias("_has"))
    tie = F.col("_close") > 1
    return out.select(
        *keys, F.when(tie & (F.col("_has") == 1), declared).otherwise(F.col("_smallest")).alias("chosen"),
        F.when(~tie, "smallest").when(F.col("_has") == 1, "tie: declared").otherwise("tie: smallest kept").alias("reason"))
