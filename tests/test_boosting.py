"""Trees grown in shared passes against growing each alone, node by node."""

import math

import numpy as np
import pytest

from tempograin.operators import boosting
from tempograin.operators import evaluation as ev

ROUNDS = 4


def grow(x, g, h):
    """One tree on training rows, best leaf first; gives a function from rows to values."""
    leaves, splits = [(np.arange(len(x)), 1)], {}

    def split(rows):
        best = None
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                l, r = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                hl, hr = h[l].sum(), h[r].sum()
                if min(len(l), len(r)) < boosting.LEAF_ROWS or min(hl, hr) < boosting.LEAF_HESSIAN:
                    continue
                gain = g[l].sum() ** 2 / hl + g[r].sum() ** 2 / hr - g[rows].sum() ** 2 / h[rows].sum()
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, cut, l, r)
        return best if best and best[0] > 1e-10 else None
    found = {1: split(leaves[0][0])}
    while len(leaves) < boosting.LEAVES:
        open_ = [(-found[n][0], n) for _, n in leaves if found[n]]
        if not open_:
            break
        n = min(open_)[1]
        _, f, cut, l, r = found[n]
        splits[n] = (f, cut)
        leaves = [v for v in leaves if v[1] != n] + [(l, 2 * n), (r, 2 * n + 1)]
        found[2 * n], found[2 * n + 1] = split(l), split(r)
    value = {n: -boosting.RATE * g[rows].sum() / h[rows].sum() for rows, n in leaves}

    def apply(row):
        n = 1
        while n in splits:
            n = 2 * n + int(row[splits[n][0]] > splits[n][1])
        return value[n]
    return lambda rows: np.array([apply(r) for r in rows])


def alone(x, y, train, classes):
    share = np.array([(y[train] == c).mean() for c in range(classes)])
    base = np.log(share[1:] / share[:1]) if classes == 2 else np.log(share)
    raw = np.tile(base, (len(x), 1))
    for _ in range(ROUNDS):
        g, h = boosting.gradients(raw, y)
        raw = raw + np.stack([grow(x[train], g[train, k] / boosting.UNIT, h[train, k] / boosting.UNIT)(x) for k in range(raw.shape[1])], axis=1)
    return raw


@pytest.mark.parametrize("classes, node_rows", [(2, 0), (2, 60), (3, 16384)])
def test_equals_models_fitted_alone(spark, monkeypatch, classes, node_rows):
    """All nodes in passes, small ones in a task, whole trees in a task."""
    monkeypatch.setattr(boosting, "NODE_ROWS", node_rows)
    monkeypatch.setattr(boosting, "ROUNDS", ROUNDS)
    monkeypatch.setattr(boosting, "KEEP", 3)
    monkeypatch.setattr(boosting, "TASK_ROWS", 90)
    monkeypatch.setattr(boosting, "LEAVES", 6)
    rng = np.random.default_rng(classes)
    rows = []
    for i in range(400):
        a, b, k = float(np.round(rng.normal(), 1)), float(rng.integers(0, 9)), "pq"[int(rng.integers(0, 2))]
        y = int(np.clip(a + 0.4 * b + (k == "p") + rng.normal(), 0, 2 * classes - 1) // 2)
        group = int(rng.integers(0, 60))
        rows.append((i, None if group == 59 else group, y if i % 40 else None, None if i % 9 == 0 else a, b, k))
    df = spark.createDataFrame(rows, "row long, subject long, label int, a double, b double, k string")
    folds = ev.assign_folds(df.selectExpr("subject", "label % 2 AS label"), "subject", "label", [11, 23], 2)
    scores, study = boosting.held_out_scores(df, folds, "subject", "row", ["a", "b"], ["k"], classes)
    got = {(r["cell"], r["row"]): r["scores"] for r in scores.collect()}
    known = [r for r in rows if r[2] is not None]
    own = {(r["seed"], r["subject"]): r["fold"] for r in folds.collect()}
    y = np.array([r[2] for r in known])
    for cell, (_, seed, fold) in enumerate(study.cells):
        train = np.array([own[seed, r[1]] != fold for r in known])
        middle = np.median([r[3] for r, t in zip(known, train) if t and r[3] is not None])
        x = np.array([[middle if r[3] is None else r[3], r[4], r[5] == "p", r[5] == "q"] for r in known], float)
        want = alone(x, y, train, classes)
        held = [i for i, t in enumerate(train) if not t]
        assert {r for c, r in got if c == cell} == {known[i][0] for i in held}
        assert max(abs(got[cell, known[i][0]][k] - want[i][k]) for i in held for k in range(want.shape[1])) < 1e-6


def test_quantile_bins_and_one_class(spark, monkeypatch):
    monkeypatch.setattr(boosting, "ROUNDS", 1)
    df = spark.createDataFrame([(i, i % 50, int(i > 600), float(i) ** 1.5) for i in range(1200)], "row long, subject long, label int, x double")
    folds = ev.assign_folds(df, "subject", "label", [11], 2)
    scores, told = boosting.score_folds(df, folds, "subject", "row", ["x"], [])
    got = scores.collect()
    assert len(got) == 1200 and len(told) == 2 and all(math.isfinite(r["p"]) for r in got)
    assert ev.auc(scores, ["fold"], "y", "p").agg({"auc": "min"}).first()[0] > 0.99
    with pytest.raises(ValueError):
        boosting.score_folds(df.selectExpr("row", "subject", "1 AS label", "x"), folds, "subject", "row", ["x"], [])


def test_nodes_that_fit_a_task_need_no_passes(spark, monkeypatch):
    """Some 20,000 training rows grow a whole tree in one task, whatever its depth."""
    monkeypatch.setattr(boosting, "ROUNDS", 1)
    monkeypatch.setattr(boosting, "_sums", lambda *a: pytest.fail("a pass for each level"))
    df = spark.range(40_000).selectExpr("id AS row", "id % 900 AS subject", "CAST(id * 7 % 11 > 4 AS int) AS label",
                                        "CAST(id * 31 % 1009 AS double) AS a", "'p' AS k")
    folds = ev.assign_folds(df, "subject", "label", [11], 2)
    scores, _ = boosting.held_out_scores(df, folds, "subject", "row", ["a"], ["k"])
    assert scores.count() == 40_000


@pytest.mark.parametrize("classes", [2, 3])
def test_rows_with_equal_bins_are_counted_and_need_no_passes(spark, monkeypatch, classes):
    """More rows than a task may hold, but few kinds of them, with gaps: the same scores as row by row."""
    monkeypatch.setattr(boosting, "NODE_ROWS", 200)
    monkeypatch.setattr(boosting, "ROUNDS", ROUNDS)
    monkeypatch.setattr(boosting, "LEAVES", 6)
    for name in ("_sums", "_below", "_absorb"):
        monkeypatch.setattr(boosting, name, lambda *a: pytest.fail("a pass for each round"))
    rng = np.random.default_rng(7)
    rows = []
    for i in range(900):
        a, b = int(rng.integers(0, 9)), int(rng.integers(0, 5))
        y = int(np.clip(a / 3 + b / 4 + rng.normal() - 1, 0, classes - 1))
        rows.append((i, i % 50, y, None if i % 9 == 0 else float(a), float(b)))
    df = spark.createDataFrame(rows, "row long, subject long, label int, a double, b double")
    folds = ev.assign_folds(df.selectExpr("subject", "label % 2 AS label"), "subject", "label", [11], 2)
    scores, study = boosting.held_out_scores(df, folds, "subject", "row", ["a", "b"], [], classes)
    got = {(r["cell"], r["row"]): r["scores"] for r in scores.collect()}
    own, y = {r["subject"]: r["fold"] for r in folds.collect()}, np.array([r[2] for r in rows])
    assert len(got) == 900
    for cell, (_, _, fold) in enumerate(study.cells):
        train = np.array([own[r[1]] != fold for r in rows])
        middle = np.median([r[3] for r, t in zip(rows, train) if t and r[3] is not None])
        x = np.array([[middle if r[3] is None else r[3], r[4]] for r in rows], float)
        want = alone(x, y, train, classes)
        assert max(abs(got[cell, i][k] - want[i][k]) for i in np.flatnonzero(~train) for k in range(want.shape[1])) < 1e-6


def test_sums_beyond_the_doubles_are_exact():
    weights = np.array([(1 << 52) + 1, (1 << 52) + 1, -(1 << 51) - 1, 3], np.int64)
    total = sum(int(np.bincount(np.zeros(4, np.int64), part, 1)[0]) * factor for part, factor in boosting._halves(weights))
    assert total == sum(weights.tolist())
