"""All folds and penalties in one pass against each model fitted alone."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tempograin.operators import evaluation as ev
from tempograin.operators import models, newton

GRID = [0.03, 1.0, 10.0]


def alone(z, y, c):
    """One penalised logistic fit, intercept free."""
    weight = np.full(z.shape[1], 1 / c)
    weight[0] = 0
    b = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(weight) + 1e-12 * np.eye(len(b)), z.T @ (p - y) + weight * b)
    return b


def auc(y, p):
    p = np.minimum((p * newton.BINS).astype(int), newton.BINS - 1)
    won = (p[y == 1][:, None] > p[y == 0]).mean() + (p[y == 1][:, None] == p[y == 0]).mean() / 2
    return won


def features(train, rows):
    out = [np.ones(len(rows))]
    for c in ("a", "b"):
        t, v = np.array([r[c] for r in train], float), np.array([r[c] for r in rows], float)
        middle = np.nanmedian(t)
        t, v = np.where(np.isnan(t), middle, t), np.where(np.isnan(v), middle, v)
        out.append((v - t.mean()) / t.std())
    for level in ("p", "q", "r"):
        out.append(np.array([float(r["k"] == level) for r in rows]))
    return np.array(out).T


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(420):
        group = int(rng.integers(0, 70))
        a, b, k = rng.normal(), rng.exponential(3), "pqr"[int(rng.integers(0, 3))]
        y = int(a + 0.3 * b + (k == "p") + rng.normal() > 1.4)
        rows.append((i, None if group == 69 else group, y if i % 50 else None, None if i % 7 == 0 else float(a), None if i % 11 == 0 else float(b), None if i % 29 == 0 else k))
    return spark.createDataFrame(rows, "row long, subject long, label int, a double, b double, k string")


def brute_force(frame, assigned):
    rows = [r.asDict() for r in frame.collect() if r["label"] is not None]
    inner = {r["subject"]: r["fold"] for r in ev.assign_folds(frame, "subject", "label", [0], 3).collect()}
    fold_of = {(r["seed"], r["subject"]): r["fold"] for r in assigned.collect()}
    chosen, scores = {}, {}
    for cell in sorted({(s, f) for (s, _), f in fold_of.items()}):
        train = [r for r in rows if fold_of[cell[0], r["subject"]] != cell[1]]
        test = [r for r in rows if fold_of[cell[0], r["subject"]] == cell[1]]
        z, y = features(train, train), np.array([r["label"] for r in train])
        j = np.array([inner[r["subject"]] for r in train])
        mean = [round(sum(auc(y[j == i], 1 / (1 + np.exp(-z[j == i] @ alone(z[j != i], y[j != i], c)))) for i in range(3)) / 3, 12) for c in GRID]
        chosen[cell] = GRID[int(np.argmax(mean))]
        p = 1 / (1 + np.exp(-features(train, test) @ alone(z, y, chosen[cell])))
        scores.update({(*cell, r["row"]): (r["label"], v) for r, v in zip(test, p)})
    return chosen, scores


def test_equals_models_fitted_alone(frame):
    assigned = ev.assign_folds(frame, "subject", "label", [11, 23], 3)
    got, told = models.score_folds(frame, assigned, "subject", "row", ["a", "b"], ["k"], grid=GRID)
    chosen, scores = brute_force(frame, assigned)
    assert {(t["seed"], t["fold"]): t["c"] for t in told} == chosen and len(set(chosen.values())) > 1
    rows = got.collect()
    assert {(r["seed"], r["fold"], r["row"]) for r in rows} == set(scores) and len(rows) == len(scores)
    for r in rows:
        y, p = scores[r["seed"], r["fold"], r["row"]]
        assert r["y"] == y and abs(r["p"] - p) < 1e-7


def test_equals_mllib(spark, frame):
    rows = [r.asDict() for r in frame.collect() if r["label"] is not None]
    assigned = ev.assign_folds(frame, "subject", "label", [11], 2)
    fold_of = {r["subject"]: r["fold"] for r in assigned.collect()}
    got, _ = newton.score_folds(frame, assigned, "subject", "row", ["a", "b"], ["k"], [1.0], 3)
    train, test = [r for r in rows if fold_of[r["subject"]] == 1], [r for r in rows if fold_of[r["subject"]] == 0]
    z = features(train, train)[:, 1:]
    df = spark.createDataFrame([(float(r["label"]), Vectors.dense(v)) for r, v in zip(train, z)], ["label", "features"])
    fit = LogisticRegression(regParam=1 / len(train), standardization=False, maxIter=300, tol=1e-12).fit(df)
    p = 1 / (1 + np.exp(-(features(train, test)[:, 1:] @ fit.coefficients.toArray() + fit.intercept)))
    mine = {r["row"]: r["p"] for r in got.filter("fold = 0").collect()}
    assert max(abs(mine[r["row"]] - v) for r, v in zip(test, p)) < 1e-5


def test_one_class_and_useless_features(spark):
    one = spark.createDataFrame([(i, i % 20, 1, 1.0, 2.0, "p") for i in range(80)], "row long, subject long, label int, a double, b double, k string")
    assigned = ev.assign_folds(one, "subject", "label", [11], 2)
    with pytest.raises(ValueError):
        newton.score_folds(one, assigned, "subject", "row", ["a"], ["k"], [1.0], 3)
    both = one.selectExpr("row", "subject", "cast(row % 2 as int) as label", "a", "cast(null as double) as b", "cast(null as string) as k")
    got, _ = newton.score_folds(both, ev.assign_folds(both, "subject", "label", [11], 2), "subject", "row", ["a", "b"], ["k"], [0.1, 1.0], 3)
    rows = got.collect()
    assert len(rows) == 80 and len({round(r["p"], 6) for r in rows}) <= 2


def test_shares_keep_part_of_the_training_groups(frame):
    assigned = ev.assign_folds(frame, "subject", "label", [11], 3)
    whole, _ = newton.score_folds(frame, assigned, "subject", "row", ["a", "b"], [], [1.0], 3)
    part, _ = newton.score_folds(frame, assigned, "subject", "row", ["a", "b"], [], [1.0], 3, train_share=0.5)
    a, b = ({r["row"]: r["p"] for r in d.collect()} for d in (whole, part))
    assert a.keys() == b.keys() and any(abs(a[i] - b[i]) > 1e-3 for i in a)


def test_variants_equal_studies_of_their_own(frame):
    from pyspark.sql import functions as F
    assigned = ev.assign_folds(frame, "subject", "label", [11], 3)
    some = F.col("k") == "p"
    got, _ = newton.score_variants(frame, assigned, "subject", "row", ["a", "b"], [], [1.0], 3, [newton.Variant(), newton.Variant(rows=some), newton.Variant(0.5)])
    by = {}
    for r in got.collect():
        by.setdefault(r["variant"], {})[r["row"]] = r["p"]
    for v, (rows, share) in enumerate([(frame, 1.0), (frame.filter(some), 1.0), (frame, 0.5)]):
        own, _ = newton.score_folds(rows, assigned, "subject", "row", ["a", "b"], [], [1.0], 3, train_share=share)
        own = {r["row"]: r["p"] for r in own.collect()}
        assert own.keys() == by[v].keys() and all(abs(own[i] - by[v][i]) < 1e-9 for i in own)


def test_models_that_share_rows_share_passes(frame, monkeypatch):
    """All C's of one training set cost Newton passes for one of them; the others need gradients only, on many rows one."""
    assigned = ev.assign_folds(frame, "subject", "label", [11], 3)
    grid = [1000.0, 2000.0, 3000.0]
    data, study = newton.laid_out(frame, assigned, "subject", "row", ["a", "b"], ["k"], grid, 3, [newton.Variant()])
    newton.prepare(data, study)
    full, sums = [], newton.sums_of

    def counted(data, study, models, beta, active, curved=True):
        full.append(len(active) if curved else 0)
        return sums(data, study, models, beta, active, curved)
    monkeypatch.setattr(newton, "sums_of", counted)
    beta = newton.fit(data, study)
    assert max(full) <= len(study.models()) // len(grid)
    each = newton.sums_of(data, study, study.models(), beta, list(range(len(beta))))[:, :study.width]
    weight = np.array([newton._penalty(study, c) for *_, c in study.models()])
    assert np.abs(each + weight * beta).max() < 1e-5


def test_medians_are_taken_from_counts(frame, monkeypatch):
    """No row is made again for a value's count, however large the counts are held to be."""
    assigned = ev.assign_folds(frame, "subject", "label", [11], 3)
    data, study = newton.laid_out(frame, assigned, "subject", "row", ["a", "b"], ["k"], GRID, 3, [newton.Variant()])
    monkeypatch.setattr(newton.F, "explode", None)
    monkeypatch.setattr(newton.session, "surely_small", lambda df: False)
    newton.prepare(data, study)
    fold = {r["subject"]: r["fold"] for r in assigned.collect()}
    for i, (_, _, f) in enumerate(study.cells):
        for j, c in enumerate(("a", "b")):
            train = [r[c] for r in frame.collect() if r["label"] is not None and fold[r["subject"]] != f]
            assert study.median[i, j] == np.nanmedian(np.array(train, float))


def test_prepared_folds_equal_mllib_fold_by_fold(frame):
    """Imputed, scaled, turned and one-hot features of all folds against a pipeline fitted on each."""
    assigned = ev.assign_folds(frame, "subject", "label", [11], 3)
    known = frame.filter("label IS NOT NULL AND subject IS NOT NULL").withColumn("c", F.col("a") * 2 + F.col("b") + F.col("row") % 5)
    data = known.join(assigned, "subject").cache()
    got = {(r["fold"], r["row"]): r["features"] for r in newton.prepared_folds(
        known, assigned, "subject", "row", ["a", "b", "c"], ["k"], 2).collect()}
    assert len(got) == known.count()
    for fold in range(3):
        fitted = models.preprocessor(["a", "b", "c"], ["k"], components=2).fit(data.filter(F.col("fold") != fold))
        rows = fitted.transform(data.filter(F.col("fold") == fold)).select("row", vector_to_array("features").alias("f")).collect()
        assert rows and all(np.allclose(got[fold, r["row"]], r["f"], atol=1e-9) for r in rows)


def test_preparing_all_folds_fits_no_pipeline(spark, monkeypatch):
    from tempograin import plans
    monkeypatch.setattr(models, "preprocessor", None)
    assert plans.all_queries()["e03_preprocessing"](spark, "/root/testdata/sf0.001").count() > 0
