"""Multiplicity and effect statistics as aggregates and running sums."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograin.functions.numeric import correlation, normal_tail, portable_hash, ratio, replicate_counts, replicate_start, resampled
from tempograin.operators.evaluation import in_ranges, spread_out
from tempograin.operators.ordered import (
    Index, Neighbour, RunningMax, RunningMin, RunningSum, average_ranks, cut, join_same, quantiles)
from tempograin.session import durable


def _ranked_tests(tests: DataFrame, p: str, name: str):
    """Tests with their rank by p and the number of tests."""
    placed = cut(tests, [], [p, name]).add(_i=Index())
    placed.df = placed.df.withColumn("_m", tests.agg(F.count(F.lit(1))).scalar())
    return placed


def benjamini_hochberg(tests: DataFrame, p: str, name: str, delta: str, alpha: float = 0.05) -> DataFrame:
    """Step-up adjusted p; significant only when the effect is positive."""
    placed = _ranked_tests(tests, p, name)
    scaled = F.col(p) * F.col("_m") / (F.col("_i") + 1)
    out = placed.add(_adj=RunningMin(scaled, backward=True)).rows()
    return (out.withColumn("p_bh", F.least(F.lit(1.0), F.col("_adj")))
            .withColumn("significant", (F.col("p_bh") < alpha) & (F.col(delta) > 0)).drop("_i", "_m", "_adj"))


def holm(tests: DataFrame, p: str, name: str, alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p."""
    placed = _ranked_tests(tests, p, name)
    out = placed.add(_adj=RunningMax((F.col("_m") - F.col("_i")) * F.col(p))).rows()
    return (out.withColumn("p_holm", F.least(F.lit(1.0), F.col("_adj")))
            .withColumn("reject", F.col("p_holm") < alpha).drop("_i", "_m", "_adj"))


EXACT_ROWS = 50


def wilcoxon(deltas: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Signed-rank test per key: zeros dropped, ties averaged.

    Up to ``EXACT_ROWS`` differences without ties or zeros p is exact, by counting the sign
    patterns; otherwise the normal approximation. All-zero differences give p = 1.
    """
    nonzero = deltas.filter(F.col(value) != 0).withColumn("_a", F.round(F.abs(F.col(value)), 12))
    ranked = average_ranks(nonzero, keys, "_a", "_r")
    sums = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(value) > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"))
    ties = (nonzero.groupBy(*keys, "_a").agg(F.count(F.lit(1)).alias("_t")).groupBy(*keys)
            .agg(F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("_tie")))
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_tie") / 48.0
    z = (F.col("w_plus") - n * (n + 1) / 4.0) / F.sqrt(F.nullif(variance, F.lit(0.0)))
    scored = join_same(sums, ties, keys).withColumn("z", z).withColumn("_p", F.least(F.lit(1.0), 2.0 * normal_tail(F.abs("z"))))
    zeros = F.count_if(F.col(value) == 0).alias("_zeros")
    groups = deltas.groupBy(*keys).agg(zeros) if keys else deltas.agg(zeros)
    countable = (F.col("_zeros") == 0) & (F.col("_tie") == 0) & F.col("n").between(1, EXACT_ROWS)
    p = F.when(countable, exact_signed_rank(F.col("w_plus"), F.col("n"))).otherwise(F.col("_p"))
    return (join_same(groups, scored, keys, "left")
            .select(*keys, F.coalesce("n", F.lit(0)).alias("n"), "w_plus", "z", F.coalesce(p, F.lit(1.0)).alias("p")))


def exact_signed_rank(w_plus: Column, n: Column) -> Column:
    """Two-sided p of a rank sum of ``n`` untied differences, from the counted null distribution."""
    none = F.lit(0.0)
    counts = F.aggregate(
        F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(1.0)),
        lambda c, k: F.zip_with(F.concat(c, F.array_repeat(none, k)), F.concat(F.array_repeat(none, k), c), lambda a, b: a + b))
    w = F.round(w_plus).cast("int")
    both = F.transform(F.array(counts), lambda c: F.least(
        F.aggregate(F.slice(c, F.lit(1), w + 1), none, lambda s, x: s + x),
        F.aggregate(F.slice(c, w + 1, F.size(c)), none, lambda s, x: s + x)))[0]
    return F.least(F.lit(1.0), 2.0 * both / F.pow(F.lit(2.0), n))


def student_tail(t: Column, df: int) -> Column:
    """P(T > t) for an integer number of degrees of freedom, by the finite series."""
    theta = F.atan(t / math.sqrt(df))
    c2 = F.cos(theta) * F.cos(theta)
    odd = df % 2 == 1
    term, total = F.lit(1.0), F.lit(1.0)
    for j in range(1, (df - 3) // 2 + 1 if odd else (df - 2) // 2 + 1):
        term = term * c2 * ((2.0 * j) / (2.0 * j + 1.0) if odd else (2.0 * j - 1.0) / (2.0 * j))
        total = total + term
    if odd:
        inner = theta + (F.sin(theta) * F.cos(theta) * total if df > 1 else F.lit(0.0))
        central = inner * (2.0 / math.pi)
    else:
        central = F.sin(theta) * total
    return 0.5 - central / 2.0


def fold_t(folds: DataFrame, value: str, n_folds: int, chance: float = 0.5) -> DataFrame:
    """One-sided p that the fold mean exceeds chance; the fold count is part of the protocol."""
    mean, sd = F.avg(value), F.stddev_samp(value)
    out = folds.agg(F.count(value).alias("n"), mean.alias("mean"), sd.alias("sd"))
    t = (F.col("mean") - chance) / F.nullif(F.col("sd") / F.sqrt(F.lit(float(n_folds))), F.lit(0.0))
    p = F.when(F.col("sd") == 0, F.when(F.col("mean") > chance, 0.0).otherwise(1.0)).otherwise(
        student_tail(F.col("t"), n_folds - 1))
    checked = F.when(F.col("n") == n_folds, F.col("n")).otherwise(
        F.raise_error(F.lit("unexpected number of folds")).cast("long"))
    return out.withColumn("t", t).withColumn("p", p).withColumn("n", checked).drop("sd")


def spearman(df: DataFrame, keys: list[str], x: str, y: str, min_rows: int = 0) -> DataFrame:
    """Rank correlation per group with tie-averaged ranks; small groups are left out."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = average_ranks(average_ranks(known, keys, x, "_rx"), keys, y, "_ry")
    stats = [F.count(F.lit(1)).alias("n"), correlation(F.col("_rx"), F.col("_ry")).alias("rho")]
    out = ranked.groupBy(*keys).agg(*stats) if keys else ranked.agg(*stats)
    return out.filter(F.col("n") >= min_rows)


# Subjects that one block of the resampled ranks holds; a block's ranks meet in one task.
BLOCK_ROWS = 8192


def _in_blocks(rows: DataFrame, value: str, n: int, block: str) -> DataFrame:
    """``rows`` with the struct ``block``: blocks ascend by ``value`` and lie in one task each.

    A value that many rows share is several blocks (``part``), whose rows have one rank (``flat``).
    """
    parts = max(1, -(-n // BLOCK_ROWS))
    placed, is_shared, _ = in_ranges(rows, value, parts)
    part = F.when(is_shared, F.pmod(F.xxhash64(*rows.columns), F.lit(parts))).otherwise(F.lit(0).cast("long"))
    return placed.withColumn(block, F.struct(F.col("_range"), part.alias("_part"), is_shared.alias("_flat"))).drop("_range")


def _block_heads(rows: DataFrame, n: int, reps: int) -> DataFrame:
    """A row per block: ``_head`` is, per replicate, the weight of all lower blocks, or twice the rank of a flat block's rows."""
    parts = max(1, -(-n // BLOCK_ROWS))
    blocks = ["_range", "_part", "_flat"]

    def weights(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, np.zeros(reps, dtype=np.int64)

        def closed():
            return pd.DataFrame({"_range": at[0], "_part": at[1], "_flat": at[2],
                                 "rep": np.arange(1, reps + 1), "_k": total})
        for batch in batches:
            for block, rows_ in batch.groupby(blocks, sort=False):
                if at is not None and block != at:
                    yield closed()
                    total = np.zeros(reps, dtype=np.int64)
                at = block
                for first in range(0, len(rows_), 512):
                    total = total + replicate_counts(rows_["_x"].to_numpy()[first:first + 512], reps).sum(axis=0)
        if at is not None:
            yield closed()
    sums = (rows.select(*blocks, "_x").repartition(parts, "_range", "_part").sortWithinPartitions(*blocks)
            .mapInPandas(weights, "_range double, _part long, _flat boolean, rep int, _k long"))
    per_range = durable(sums.groupBy("_range", "_flat", "rep").agg(F.sum("_k").alias("_k")))
    lower = Window.partitionBy("rep").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_k").over(lower), F.lit(0))
    start = per_range.withColumn("_below", below).withColumn(
        "_start", F.when(F.col("_flat"), 2 * F.col("_below") + F.col("_k") + 1).otherwise(F.col("_below")))
    heads = start.groupBy("_range", "_flat").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rep", "_start"))), lambda s: s["_start"]).alias("_head"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))
    return heads.withColumn("_part", F.explode(F.when(F.col("_flat"), every).otherwise(F.array(F.lit(0).cast("long")))))


def _led(rows: DataFrame, heads: DataFrame, value: str, n: int) -> DataFrame:
    """Every block's head before its rows, which ascend by ``value``."""
    return (rows.unionByName(heads, allowMissingColumns=True).withColumn("_row", F.col("_head").isNull())
            .repartition(max(1, -(-n // BLOCK_ROWS)), "_range", "_part")
            .sortWithinPartitions("_range", "_part", "_row", value))


def _replicate_ranks(batches: Iterator[pd.DataFrame], value: str, reps: int):
    """Of the rows of :func:`_led`: (rows, their counts, twice their average ranks), a column per replicate."""
    held, before, flat = None, None, False

    def counts_of(rows):
        return replicate_counts(rows["_x"].to_numpy().astype(np.int64), reps)

    def slices(rows):
        return (rows.iloc[first:first + 512] for first in range(0, len(rows), 512))

    def close(rows):
        nonlocal before
        values = rows[value].to_numpy()
        starts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
        ends = np.append(starts[1:], len(rows))
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + 512, "right")))
            block = rows.iloc[starts[i]:ends[j - 1]]
            if len(block) <= 512:
                counts = counts_of(block)
                sums = np.add.reduceat(counts, starts[i:j] - starts[i], axis=0)
                upto = before + np.cumsum(sums, axis=0)
                yield block, counts, np.repeat(2 * upto - sums + 1, ends[i:j] - starts[i:j], axis=0)
                before = upto[-1]
            else:
                tied = sum(counts_of(some).sum(axis=0) for some in slices(block))
                for some in slices(block):
                    yield some, counts_of(some), np.broadcast_to(2 * before + tied + 1, (len(some), reps))
                before = before + tied
            i = j
    for batch in batches:
        heads = np.flatnonzero(batch["_head"].notna())
        for i, j in zip([0, *heads], [*heads, len(batch)]):
            rows = batch.iloc[i:j]
            if len(rows) and rows["_head"].iloc[0] is not None:
                if held is not None:
                    yield from close(held)
                held, before, flat = None, np.array(rows["_head"].iloc[0], dtype=np.int64), bool(rows["_flat"].iloc[0])
                rows = rows.iloc[1:]
            if not len(rows):
                continue
            if flat:
                for some in slices(rows):
                    yield some, counts_of(some), np.broadcast_to(before, (len(some), reps))
                continue
            # The last value may go on in the next batch.
            rows = rows if held is None else pd.concat([held, rows])
            values = rows[value].to_numpy()
            last = int(np.argmax(values == values[-1]))
            if last:
                yield from close(rows.iloc[:last])
            held = rows.iloc[last:]
    if held is not None:
        yield from close(held)


def _packed(ranks: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Each row's middle and its differences from it, of two bytes where they fit."""
    middle = ranks.mean(axis=1).astype(np.int64)
    away = ranks - middle[:, None]
    short = np.abs(away).max(axis=1) < 2 ** 15
    return middle, [row.astype("<i2" if s else "<i4").tobytes() for row, s in zip(away, short)]


def _unpacked(middle: np.ndarray, away: list[bytes], reps: int) -> np.ndarray:
    return np.stack([np.frombuffer(a, dtype="<i2" if len(a) == 2 * reps else "<i4") for a in away]) + middle[:, None]


def bootstrap_spearman(per_subject: DataFrame, subject: str, x: str, y: str, reps: int, seed: int) -> DataFrame:
    """Interval of the rank correlation over resampled subjects.

    Subjects are put in blocks by ``x``, whose tasks form the ranks of a subject in all replicates;
    these travel as one packed value to the subject's block by ``y``, whose task adds up the products.
    No row per subject and replicate is made; a task holds a block, whatever the number of subjects.
    """
    values = durable(per_subject.select(F.col(x).cast("double").alias("_vx"), F.col(y).cast("double").alias("_vy"),
                                        replicate_start([subject], seed).alias("_x")))
    n = values.count()
    rows = durable(_in_blocks(_in_blocks(values, "_vx", n, "_bx"), "_vy", n, "_by"))
    with_x, with_y = (rows.filter(F.col(v).isNotNull()).select("*", f"{b}.*") for v, b in (("_vx", "_bx"), ("_vy", "_by")))

    def rank_by_x(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, _, ranks in _replicate_ranks(batches, "_vx", reps):
            middle, away = _packed(ranks)
            yield part[["_vy", "_x", "_r", "_p", "_f"]].assign(_mid=middle, _away=away)

    def sum_by_y(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((6, reps))
        for part, counts, ranks in _replicate_ranks(batches, "_vy", reps):
            ranked = part["_away"].notna().to_numpy()
            if not ranked.any():
                continue
            # Ranks from the middle of all, so that the products stay small.
            a = _unpacked(part["_mid"].to_numpy()[ranked].astype(np.int64), part["_away"][ranked], reps) - (n + 1.0)
            b, w = ranks[ranked] - (n + 1.0), counts[ranked].astype(float)
            wa, wb = w * a, w * b
            sums += [w.sum(0), wa.sum(0), wb.sum(0), (wa * b).sum(0), (wa * a).sum(0), (wb * b).sum(0)]
        if sums.any():
            yield pd.DataFrame({"rep": np.arange(1, reps + 1), **dict(zip(names, sums))})
    names = ["n", "a", "b", "ab", "aa", "bb"]
    place = [F.col("_by")[c].alias(a) for c, a in (("_range", "_r"), ("_part", "_p"), ("_flat", "_f"))]
    by_x = _led(with_x.select("_vx", "_vy", "_x", "_range", "_part", "_flat", *place),
                _block_heads(with_x, n, reps), "_vx", n).mapInPandas(
        rank_by_x, "_vy double, _x long, _r double, _p long, _f boolean, _mid long, _away binary")
    # A subject without x has no rank in x but counts in the ranks of y.
    ranked = by_x.unionByName(rows.filter("_vx is null").select("_vy", "_x", *place), allowMissingColumns=True)
    ranked = ranked.filter("_vy is not null").withColumnsRenamed({"_r": "_range", "_p": "_part", "_f": "_flat"})
    sums = _led(ranked, _block_heads(with_y, n, reps), "_vy", n).mapInPandas(
        sum_by_y, "rep int, " + ", ".join(f"{c} double" for c in names))
    s = {c: F.sum(c) for c in names}
    total = F.nullif(s["n"], F.lit(0.0))
    ma, mb = s["a"] / total, s["b"] / total
    cov, va, vb = s["ab"] / total - ma * mb, s["aa"] / total - ma * ma, s["bb"] / total - mb * mb
    rhos = durable(sums.groupBy("rep").agg(
        ratio(cov, F.sqrt(F.greatest(va * vb, F.lit(0.0)))).alias("rho"), s["n"].alias("n")).filter("n > 0").drop("n"))
    q = quantiles(rhos, [], "rho", {"lo": 0.025, "hi": 0.975})
    return spearman(per_subject, [], x, y).withColumns({c: q.select(c).scalar() for c in ("lo", "hi")})


def bootstrap_slope(per_subject: DataFrame, subject: str, x: str, y: str, reps: int, seed: int) -> DataFrame:
    """Least-squares slope with an interval over resampled subjects."""
    draws = resampled(spread_out(per_subject.select(subject, x, y)), [subject], reps, seed)
    w, a, b = F.col("w"), F.col(x), F.col(y)
    n = F.sum(w)
    ma, mb = F.sum(w * a) / n, F.sum(w * b) / n
    slopes = durable(draws.groupBy("rep").agg(
        ratio(F.sum(w * a * b) / n - ma * mb, F.sum(w * a * a) / n - ma * ma).alias("slope")))
    q = quantiles(slopes, [], "slope", {"lo": 0.025, "hi": 0.975})
    return ols(per_subject, [], x, y).select("n", "slope").withColumns({c: q.select(c).scalar() for c in ("lo", "hi")})


def ols(df: DataFrame, keys: list[str], x: str, y: str, min_rows: int = 2) -> DataFrame:
    """Slope, intercept and R² of y on x; slope and R² are NULL where x or y is flat."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = [F.count(F.lit(1)).alias("n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
            F.covar_pop(x, y).alias("_c"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"),
            F.avg(F.abs(F.col(y) - F.col(x))).alias("mean_abs_gap")]
    out = (known.groupBy(*keys).agg(*sums) if keys else known.agg(*sums)).filter(F.col("n") >= min_rows)
    slope = F.when(F.col("_vx") > 1e-18, F.col("_c") / F.col("_vx"))
    return out.select(*keys, "n", slope.alias("slope"), (F.col("_my") - slope * F.col("_mx")).alias("intercept"),
                      F.when(F.col("_vy") > 1e-18, slope * F.col("_c") / F.col("_vy")).alias("r2"), "mean_abs_gap")


# ------------------------------------------------------------------ least squares by Gram

def gram(df: DataFrame, features: list[str], target: str, keys: list[str] | None = None) -> dict:
    """n, X'X, X'y and y'y (X with an intercept) per key, from one aggregation pass."""
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(target).cast("double")]
    k = len(cols)
    cells = [F.sum(cols[i] * cols[j]).alias(f"_{i}_{j}") for i in range(k) for j in range(i, k)]
    known = df.dropna(subset=[*features, target])
    rows = (known.groupBy(*keys).agg(*cells) if keys else known.agg(*cells)).collect()
    out = {}
    for row in rows:
        full = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                full[i, j] = full[j, i] = row[f"_{i}_{j}"]
        out[tuple(row[c] for c in keys) if keys else ()] = full
    return out


def multiple_ols(df: DataFrame, features: list[str], target: str, min_rows: int = 20) -> DataFrame:
    """Coefficients with 95 % intervals and R². Only the k×k sums reach the driver."""
    full = gram(df, features, target)[()]
    xx, xy, yy, n = full[:-1, :-1], full[:-1, -1], full[-1, -1], full[0, 0]
    beta = np.linalg.solve(xx, xy)
    sse = float(yy - beta @ xy)
    s2 = sse / (n - len(beta))
    se = np.sqrt(np.diag(s2 * np.linalg.inv(xx)))
    r2 = 1.0 - sse / (yy - xy[0] ** 2 / n)
    if n < min_rows:
        raise ValueError(f"{int(n)} complete rows, fewer than {min_rows}")
    rows = [(name, int(n), float(b), float(b - 1.96 * e), float(b + 1.96 * e), float(r2))
            for name, b, e in zip(["intercept", *features], beta, se)]
    return df.sparkSession.createDataFrame(
        rows, "term string, n bigint, slope double, lo double, hi double, r2 double")


def residualise(df: DataFrame, covariates: list[str], targets: list[str]) -> DataFrame:
    """Add ``<target>_resid``: what a linear fit on the covariates leaves over.

    Missing covariates take their median. One pass of sums and a k×k solve per target.
    """
    middle = quantiles_row(df, covariates)
    filled = df.withColumns({c: F.coalesce(F.col(c), F.lit(middle[c])) for c in covariates})
    out = {}
    for t in targets:
        full = gram(filled, covariates, t)[()]
        beta = np.linalg.solve(full[:-1, :-1], full[:-1, -1])
        fit = F.lit(float(beta[0]))
        for c, b in zip(covariates, beta[1:]):
            fit = fit + float(b) * F.col(c)
        out[f"{t}_resid"] = F.col(t) - fit
    return filled.withColumns(out)


def quantiles_row(df: DataFrame, columns: list[str], p: float = 0.5) -> dict:
    return {c: quantiles(df, [], c, {"m": p}).first()["m"] for c in columns}


def ridge_out_of_fold(df: DataFrame, fold: str, features: list[str], target: str, alphas: list[float]) -> DataFrame:
    """Held-out prediction of a log target by ridge, corrected by Duan's smearing factor.

    Gram sums per fold come from one pass; training sums are totals minus the fold. The
    penalty is the one with the least squared error over the training rows when each is
    left out in turn (the smallest of equals): with the eigenvectors of the training side's
    standardised Gram matrix a row's leverage under every penalty is a short sum, so all
    penalties of a fold take one further pass. The smearing factor (mean of exp(residual))
    is taken over training rows only, in a last pass. Rows without a fold or with an
    undefined value are left out of every sum; a prediction needs a fold and the features.
    """
    features_ = [F.col(f).cast("double") for f in features]
    whole = df.filter(reduce(and_, [F.nanvl(c, F.lit(None)).isNotNull() for c in [*features_, F.col(target).cast("double")]]) & F.col(fold).isNotNull())
    per = {k[0]: v for k, v in gram(whole, features, target, [fold]).items()}
    total = sum(per.values())
    models = {}
    for held in per:
        full = total - per[held]
        n = full[0, 0]
        if n <= 1:
            raise ValueError("ridge needs at least two training rows in each fold")
        mean = full[0, 1:-1] / n
        sd = np.sqrt(np.maximum(np.diag(full)[1:-1] / n - mean ** 2, 1e-18))
        centred = (full[1:-1, 1:-1] - n * np.outer(mean, mean)) / np.outer(sd, sd)
        values, vectors = np.linalg.eigh(centred)
        middle = full[0, -1] / n
        along = vectors.T @ ((full[1:-1, -1] - n * mean * middle) / sd)
        models[held] = (n, mean, vectors / sd[:, None], np.maximum(values, 0.0), along, middle)

    def summed(terms: list[Column]) -> Column:
        return sum(terms[1:], terms[0])

    # Plain columns, no arrays: the sums over all folds and penalties stay in generated code.
    turned = {f"_u{i}_{j}": summed([float(w) * (c - float(m)) for w, c, m in zip(column, features_, models[h][1])])
              for i, h in enumerate(per) for j, column in enumerate(models[h][2].T)}
    training = whole.select(fold, F.col(target).cast("double").alias("_y"), *[c.alias(n) for n, c in turned.items()])

    def left_out_error(i: int, held, alpha: float) -> Column:
        """The mean squared error of the fold's training rows, each left out once."""
        n, _, _, values, along, middle = models[held]
        u = [F.col(f"_u{i}_{j}") for j in range(len(values))]
        fit = summed([float(c / (v + alpha)) * u[j] for j, (c, v) in enumerate(zip(along, values))])
        leverage = summed([float(1 / (v + alpha)) * u[j] * u[j] for j, v in enumerate(values)])
        gap = ratio(F.col("_y") - float(middle) - fit, 1.0 - float(1 / n) - leverage)
        return F.avg(gap * gap)
    # A scan a fold: the sums of all folds in one would be code too long to be compiled to machine code.
    each = [training.filter(F.col(fold) != F.lit(h)).agg(F.array(*[left_out_error(i, h, a) for a in alphas]).alias("c"))
            .select(F.lit(i).alias("i"), "c") for i, h in enumerate(per)]
    costs = {r["i"]: r["c"] for r in reduce(DataFrame.unionByName, each).collect()} if each else {}
    betas = {}
    for i, held in enumerate(per):
        n, mean, turn, values, along, middle = models[held]
        alpha = min((c, a) for c, a in zip(costs[i], alphas) if c is not None)[1]
        slopes = turn @ (along / (values + alpha))
        betas[held] = np.concatenate([[middle - slopes @ mean], slopes])
    held_out = sorted(per)

    def fit(beta: np.ndarray) -> Column:
        total_ = F.lit(float(beta[0]))
        for f, b in zip(features, beta[1:]):
            total_ = total_ + float(b) * F.col(f)
        return total_
    smear = whole.agg(*[F.avg(F.when(F.col(fold) != h, F.exp(F.col(target) - fit(betas[h])))).alias(f"_{i}")
                     for i, h in enumerate(held_out)]).first()
    pred = F.lit(None).cast("double")
    for i, h in enumerate(held_out):
        pred = F.when(F.col(fold) == h, fit(betas[h]) + math.log(max(smear[f"_{i}"], 1e-12))).otherwise(pred)
    return df.withColumn("oof", pred)


def shuffle_within(df: DataFrame, clip: list[str], value: str, order: str, seed: int) -> DataFrame:
    """Permute a column within each clip: rank by hash meets rank by order."""
    hashed = df.withColumn("_h", portable_hash(F.lit(seed), F.col(order)))
    first = cut(df, clip, [order]).add(_i=Index()).rows()
    second = (cut(hashed, clip, ["_h", order]).add(_i=Index()).rows()
              .select(*clip, "_i", F.col(value).alias("shuffled")))
    return first.join(second, [*clip, "_i"]).drop("_i")


def first_crossing(sweep: DataFrame, keys: list[str], x: str, y: str, target: float) -> DataFrame:
    """Smallest x where y reaches the target, interpolated; NULL when it never does."""
    ordered = cut(sweep, keys, [x]).add(_x0=Neighbour(F.col(x)), _y0=Neighbour(F.col(y))).rows()
    rises = (F.col("_y0") < target) & (F.col(y) >= target)
    at = F.col("_x0") + (F.lit(target) - F.col("_y0")) / F.nullif(F.col(y) - F.col("_y0"), F.lit(0.0)) * (F.col(x) - F.col("_x0"))
    crossing = F.min_by(F.when(rises, at), F.when(rises, F.col(x))).alias("crossing")
    return ordered.groupBy(*keys).agg(crossing) if keys else ordered.agg(crossing)


def saturation(curve: DataFrame, x: str, y: str, bar: float = 0.01) -> DataFrame:
    """Total gain, last increment, and whether the learning curve has flattened."""
    step = cut(curve, [], [x]).add(_y0=Neighbour(F.col(y))).rows()
    out = step.agg(
        (F.max_by(y, x) - F.min_by(y, x)).alias("gain"), F.max_by(F.col(y) - F.col("_y0"), x).alias("last_increment"))
    return out.withColumn("saturated", F.round("last_increment", 9) <= bar)
