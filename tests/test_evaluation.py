"""Folds, scores, intervals and statistics against brute force; guards must fire."""

import itertools

import numpy as np
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tempograin.functions.numeric import resampled
from tempograin.operators import evaluation as ev
from tempograin.operators import joins
from tempograin.operators import statistics as st


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(s), int(y), float(round(p, 2))) for i, (s, y, p) in enumerate(
        zip(rng.integers(0, 60, 200), rng.integers(0, 2, 200), rng.random(200)))]
    return spark.createDataFrame(rows, "row bigint, subject bigint, y int, p double").cache()


def test_every_group_is_tested_once_per_seed_and_never_leaks(spark, cohort):
    folds = ev.assign_folds(cohort, "subject", "y")
    per = folds.groupBy("seed", "subject").count().agg(F.max("count"), F.count("*")).first()
    assert per[0] == 1 and per[1] == 5 * cohort.select("subject").distinct().count()
    assert joins.require_no_leak(ev.fold_roles(folds), ["seed", "fold"], "subject").filter("not clean").count() == 0


def test_leak_guard_fires(spark):
    bad = spark.createDataFrame([(1, 0, 7, "train"), (1, 0, 7, "test")], "seed int, fold int, subject int, role string")
    with pytest.raises(SparkRuntimeException, match="train and test"):
        joins.require_no_leak(bad, ["seed", "fold"], "subject").collect()


def brute_auc(y, p):
    pos, neg = [b for a, b in zip(y, p) if a], [b for a, b in zip(y, p) if not a]
    return np.mean([(a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)])


@pytest.mark.parametrize("rows", [0, 30])
def test_auc_and_ap(spark, cohort, chunked, rows):
    if rows:
        chunked(rows)
    pdf = cohort.toPandas()
    assert abs(ev.auc(cohort, [], "y", "p").first()["auc"] - brute_auc(pdf.y, pdf.p)) < 1e-12
    ap, tp, k = 0.0, 0, 0
    for s in sorted(pdf.p.unique(), reverse=True):
        m = pdf[pdf.p == s]
        tp, k = tp + m.y.sum(), k + len(m)
        ap += m.y.sum() / pdf.y.sum() * tp / k
    assert abs(ev.average_precision(cohort, [], "y", "p").first()["ap"] - ap) < 1e-12


def test_single_class_auc_is_null(spark, cohort):
    assert ev.auc(cohort.filter("y = 1"), [], "y", "p").first()["auc"] is None


@pytest.mark.parametrize("rows", [0, 30])
def test_pair_statistics_without_pairs(spark, cohort, chunked, rows):
    if rows:
        chunked(rows)
    one = cohort.withColumn("y", F.lit(1))
    got = ev.repeat_summary(ev.repeat_agreement(one, "subject", "y", "p", "row"), one, "subject").first()
    pairs = []
    for _, g in one.toPandas().sort_values("row").groupby("subject"):
        pairs += list(itertools.combinations(g.p, 2))
    a = np.array(pairs)
    assert got["n_session_pairs"] == len(a)
    np.testing.assert_allclose(got["binary_agreement"], np.mean((a[:, 0] > .5) == (a[:, 1] > .5)))
    np.testing.assert_allclose(got["mean_abs_score_diff"], np.abs(a[:, 0] - a[:, 1]).mean())
    np.testing.assert_allclose(got["score_corr"], np.corrcoef(a[:, 0], a[:, 1])[0, 1])


def test_replicate_counts_are_independent_poisson_counts(spark):
    units, reps = 2000, 40
    got = resampled(spark.range(units), ["id"], reps, 1).toPandas()
    w = got.pivot(index="id", columns="rep", values="w").reindex(range(units)).fillna(0).to_numpy()
    assert w.shape == (units, reps)
    np.testing.assert_allclose([w.mean(), w.var()], 1, atol=0.02)
    across = np.corrcoef(w.T) - np.eye(reps)
    assert np.abs(across).max() < 4.5 / np.sqrt(units)
    # The mean of a replicate over units varies as that of independent counts does.
    assert 0.5 < w.mean(axis=0).var() * units < 1.7


@pytest.mark.parametrize("tied", [False, True])
def test_bootstrap_auc_equals_the_auc_of_every_replicate(spark, cohort, tied):
    df = cohort.withColumn("p", F.when(F.col("row") % 3 > 0, 0.5).otherwise(F.col("p"))) if tied else cohort
    got = ev.bootstrap_auc(df, "subject", "y", "p", 60, 3, min_kept=1).first()
    rows = resampled(df, ["subject"], 60, 3).toPandas()
    aucs = []
    for _, g in rows.groupby("rep"):
        up, down = g[g.y == 1], g[g.y == 0]
        gap = np.subtract.outer(up.p.to_numpy(), down.p.to_numpy())
        if len(up) and len(down):
            won = np.outer(up.w, down.w) * ((gap > 0) + (gap == 0) / 2)
            aucs.append(won.sum() / (up.w.sum() * down.w.sum()))
    assert got["n_kept"] == len(aucs)
    np.testing.assert_allclose([got["lo"], got["hi"]], np.quantile(aucs, [0.025, 0.975]))


def test_bootstrap_interval_is_null_below_two_subjects(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 1.0), ("b", 2, 3.0)], "arm string, subject bigint, v double")
    out = {r["arm"]: r for r in ev.bootstrap_mean(df, ["arm"], "subject", "v", 50, 1).collect()}
    assert out["a"]["lo"] is None and out["b"]["lo"] is not None


def test_fold_mismatch_raises(spark):
    a = spark.createDataFrame([(1, 0, 0.6)], "seed int, fold int, auc double")
    b = spark.createDataFrame([(1, 1, 0.5)], "seed int, fold int, auc double")
    with pytest.raises(SparkRuntimeException, match="same folds"):
        ev.paired_fold_delta(a, b, ["seed", "fold"], "auc").collect()


def test_control_gate_aborts(spark):
    c = spark.createDataFrame([("ok", 0.51), ("leak", 0.7)], "name string, auc double")
    assert ev.control_gate(c, 0.08).first()["passed"] is False
    with pytest.raises(SparkRuntimeException, match="not at chance"):
        ev.control_gate(c, 0.08, strict=True).collect()


@pytest.mark.parametrize("rows", [0, 5])
def test_multiplicity(spark, chunked, rows):
    if rows:
        chunked(rows)
    ps = [0.01, 0.04, 0.03, 0.005, 0.6, 0.04, 0.9, 0.2]
    df = spark.createDataFrame([(i, p, 1.0) for i, p in enumerate(ps)], "name int, p double, delta double")
    m, order = len(ps), np.argsort(ps, kind="stable")
    bh, run = [0.0] * m, 1.0
    for k in range(m - 1, -1, -1):
        run = min(run, ps[order[k]] * m / (k + 1))
        bh[order[k]] = run
    holm, run = [0.0] * m, 0.0
    for k in range(m):
        run = max(run, (m - k) * ps[order[k]])
        holm[order[k]] = min(1.0, run)
    np.testing.assert_allclose([r["p_bh"] for r in st.benjamini_hochberg(df, "p", "name", "delta").orderBy("name").collect()], bh)
    np.testing.assert_allclose([r["p_holm"] for r in st.holm(df, "p", "name").orderBy("name").collect()], holm)


def test_wilcoxon_all_zero_is_one_and_tail_is_right(spark):
    df = spark.createDataFrame([("z", 0.0), ("z", 0.0)] + [("a", float(v)) for v in (1, 2, 3, -1, 5, 8, 2, 4)], "k string, d double")
    out = {r["k"]: r for r in st.wilcoxon(df, ["k"], "d").collect()}
    assert out["z"]["p"] == 1.0 and out["z"]["n"] == 0
    z = out["a"]["z"]
    import math
    assert abs(out["a"]["p"] - math.erfc(abs(z) / math.sqrt(2))) < 1e-12


@pytest.mark.parametrize("df,t,p", [(4, 2.776, 0.025), (24, 1.711, 0.05), (9, 2.262, 0.025), (1, 6.314, 0.05), (30, -1.697, 0.95)])
def test_student_tail(spark, df, t, p):
    got = spark.range(1).select(st.student_tail(F.lit(t), df).alias("p")).first()["p"]
    assert abs(got - p) < 2e-4


def test_multiple_ols_and_ridge(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = 1 + x @ [2.0, -3.0] + rng.normal(0, 0.1, 300)
    df = spark.createDataFrame([(float(a), float(b), float(c), i % 5) for i, ((a, b), c) in enumerate(zip(x, y))], "a double, b double, y double, fold int")
    fit = {r["term"]: r for r in st.multiple_ols(df, ["a", "b"], "y").collect()}
    want = np.linalg.lstsq(np.c_[np.ones(300), x], y, rcond=None)[0]
    np.testing.assert_allclose([fit[k]["slope"] for k in ("intercept", "a", "b")], want)
    assert fit["a"]["lo"] < 2.0 < fit["a"]["hi"]
    out = st.ridge_out_of_fold(df, "fold", ["a", "b"], "y", [1e-3, 1.0, 1e3]).toPandas()
    assert np.corrcoef(out.oof, out.y)[0, 1] > 0.99


def ridge(x, y, alpha, mean, sd):
    z = (x - mean) / sd
    centre, middle = z.mean(axis=0), y.mean()
    w = np.linalg.solve((z - centre).T @ (z - centre) + alpha * np.eye(z.shape[1]), (z - centre).T @ (y - middle))
    return lambda new: middle + ((new - mean) / sd - centre) @ w


@pytest.mark.parametrize("noise", [0.05, 3.0, 40.0])
def test_ridge_equals_leaving_each_row_out(spark, noise):
    """Penalties are chosen as by fitting once without each training row."""
    rng = np.random.default_rng(int(noise))
    x = rng.normal(size=(40, 3)) * [1, 50, 0.01] + [3, -20, 0]
    x[:, 2] += x[:, 0] / 200
    y = x @ [1.0, 0.1, 20.0] / 10 + rng.normal(0, noise / 10, 40)
    fold, alphas = np.arange(40) % 4, [10.0 ** (e / 2) for e in range(-6, 7)]
    want, chosen = np.zeros(40), []
    for held in range(4):
        a, b = x[fold != held], y[fold != held]
        mean, sd = a.mean(axis=0), a.std(axis=0)
        costs = []
        for alpha in alphas:
            rest = [np.arange(len(b)) != i for i in range(len(b))]
            costs.append(np.mean([(b[i] - ridge(a[r], b[r], alpha, mean, sd)(a[i])) ** 2 for i, r in enumerate(rest)]))
        chosen.append(alphas[int(np.argmin(costs))])
        fitted = ridge(a, b, chosen[-1], mean, sd)
        want[fold == held] = fitted(x[fold == held]) + np.log(np.mean(np.exp(b - fitted(a))))
    rows = [(i, *map(float, v), float(t), int(f)) for i, (v, t, f) in enumerate(zip(x, y, fold))]
    rows += [(40, None, 1.0, 1.0, 1.0, 0), (41, 1.0, float("nan"), 1.0, 1.0, 1), (42, 1.0, 1.0, 1.0, 1.0, None), (43, 1.0, 1.0, 1.0, None, 2)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, y double, fold int")
    got = [r.oof for r in st.ridge_out_of_fold(df, "fold", ["a", "b", "c"], "y", alphas).orderBy("i").collect()]
    np.testing.assert_allclose(got[:40], want, rtol=1e-9)
    assert got[40] is None and np.isnan(got[41]) and got[42] is None and got[43] is not None
    assert noise < 1 or max(chosen) > 1e-3


def test_selective_curve_keeps_half_even_counts(spark):
    df = spark.createDataFrame([(0, i, i % 2, (i + 0.5) / 25) for i in range(25)], "fold int, row int, y int, p double")
    kept = ev.most_confident(df, ["fold"], "p", "row", [0.1, 0.5, 0.01]).groupBy("coverage").count().collect()
    assert {r["coverage"]: r["count"] for r in kept} == {0.1: 2, 0.5: 12, 0.01: 2}


def mid_ranks(values, weights):
    return np.array([weights[values < v].sum() + (weights[values == v].sum() + 1) / 2 for v in values])


def test_bootstrap_spearman_in_blocks_equals_ranks_of_every_replicate(spark, monkeypatch):
    # No row per subject and replicate may be made; blocks of 16 make ties cross blocks and tasks.
    monkeypatch.setattr(st, "BLOCK_ROWS", 16)
    monkeypatch.setattr(st, "resampled", lambda *a: pytest.fail("a row per subject and replicate"))
    rng = np.random.default_rng(3)
    x = np.where(rng.random(300) < 0.4, 7.0, rng.integers(0, 60, 300)).astype(float)
    y = np.where(rng.random(300) < 0.3, -1.0, np.round(x / 9 + rng.normal(0, 3, 300), 1))
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "s bigint, x double, y double")
    got = st.bootstrap_spearman(rows, "s", "x", "y", 40, 5).first()
    draws = {(r["rep"], r["s"]): r["w"] for r in resampled(rows.select("s"), ["s"], 40, 5).collect()}
    rhos = []
    for rep in range(1, 41):
        w = np.array([draws.get((rep, s), 0) for s in range(300)])
        a, b = mid_ranks(x, w), mid_ranks(y, w)
        a, b = a - np.average(a, weights=w), b - np.average(b, weights=w)
        rhos.append((w * a * b).sum() / np.sqrt((w * a * a).sum() * (w * b * b).sum()))
    np.testing.assert_allclose([got["lo"], got["hi"]], np.quantile(rhos, [0.025, 0.975]), atol=1e-12)


def test_packed_ranks_of_both_widths_come_back():
    ranks = np.array([[5, 9, 3], [10, 900_000, 40], [2 ** 33, 2 ** 33 + 7, 2 ** 33 - 5]])
    middle, away = st._packed(ranks)
    assert [len(a) for a in away] == [6, 12, 6]
    np.testing.assert_array_equal(st._unpacked(middle, away, 3), ranks)


def test_only_rows_at_the_end_of_a_coverage_are_ranked(spark, monkeypatch):
    """Ties at the end go by row; nulls and NaN, null folds and folds smaller than two rows keep their place."""
    from tempograin.operators import evaluation as ev
    rows = [(f, i, None if i % 31 == 0 else float("nan") if i % 29 == 0 else 0.5 + (i * 37 % 9 - 4) / 10) for f in (1, 2, None) for i in range(200)]
    rows += [(3, 0, 0.5)]
    df = spark.createDataFrame(rows, "fold int, row long, p double")
    levels = [1.0, 0.55, 0.3, 0.004]
    seen, cut = [], ev.cut

    def counted(part, keys, order):
        seen.append(part.count())
        return cut(part, keys, order)
    monkeypatch.setattr(ev, "cut", counted)
    got = sorted((-1 if r["fold"] is None else r["fold"], r["coverage"], r["row"]) for r in ev.most_confident(df, ["fold"], "p", "row", levels).collect())
    want = []
    for f in (1, 2, None, 3):
        own = [(0 if p is None else 1 if p == p else 3, -round(abs(p - 0.5), 9) if p is not None and p == p else 0, i) for g, i, p in rows if g == f]
        own.sort()
        want += [(-1 if f is None else f, c, i) for c in levels for _, _, i in own[:max(2, round(round(c * len(own), 6)))]]
    assert got == sorted(want)
    assert max(seen) < len(rows) / 2
