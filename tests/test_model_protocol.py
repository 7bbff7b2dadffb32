"""The model queries run the whole protocol; the fits themselves are small here."""

import numpy as np

from tempograin import plans
from tempograin.operators import evaluation as ev
from tempograin.operators import boosting, models, newton

FOLDER = "/root/testdata/sf0.001"
CELLS = {(s, f) for s in (11, 23, 37, 53, 71) for f in range(5)}


def test_queries_pass_all_folds_and_values(spark, monkeypatch):
    seen = []

    def score_folds(frame, assigned, group, row, *rest, kind="logit", grid=None, train_share=1.0, **other):
        cells = {tuple(r) for r in assigned.select("seed", "fold").distinct().collect()}
        seen.append((cells, grid, train_share))
        none = "seed int, fold int, y int, p double"
        return spark.createDataFrame([(11, 0, 1, 0.5), (11, 0, 0, 0.5)], none), [{"seed": 11, "fold": 0, "c": 1.0}]

    def score_variants(frame, assigned, group, row, numeric, categorical, grid, inner, variants):
        assert grid == [0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0] and inner == 3
        cells = {tuple(r) for r in assigned.select("seed", "fold").distinct().collect()}
        seen.extend((cells, None, v.share) for v in variants)
        return spark.createDataFrame([(0, 11, 0, 1, 0.5), (0, 11, 0, 0, 0.5)], "variant int, seed int, fold int, y int, p double"), []
    monkeypatch.setattr(models, "score_folds", score_folds)
    monkeypatch.setattr(newton, "score_variants", score_variants)
    for name in ("e04_inner_choice", "e05_fold_scores", "e19_learning_curve"):
        plans.all_queries()[name](spark, FOLDER)
    assert all(cells == CELLS and grid is None for cells, grid, _ in seen)
    assert [share for *_, share in seen] == [1.0, 1.0, 0.25, 0.5, 0.75, 1.0]


def test_waves_are_told_by_boosted_trees(spark, monkeypatch):
    assert (boosting.ROUNDS, boosting.LEAVES, boosting.LEAF_ROWS) == (100, 31, 20)
    monkeypatch.setattr(boosting, "ROUNDS", 4)
    rng = np.random.default_rng(1)
    rows = [(i % 40, 2010 + i % 40 % 3, float(i % 40 % 3 + rng.normal(0, 0.1))) for i in range(240)]
    df = spark.createDataFrame(rows, "subject long, wave int, x double")
    folds = ev.assign_folds(df.selectExpr("subject", "wave % 2 AS label"), "subject", "label", [11], 2)
    got = models.wave_accuracy(df, folds, "subject", "wave", ["x"]).collect()
    assert len(got) == 2 and all(r["accuracy"] > 0.9 > r["baseline"] for r in got)
    own = {r["subject"]: r["fold"] for r in folds.collect()}
    for r in got:
        train = [w for s, w, _ in rows if own[s] != r["fold"]]
        test = [w for s, w, _ in rows if own[s] == r["fold"]]
        modal = min(set(train), key=lambda w: (-train.count(w), w))
        assert abs(r["baseline"] - test.count(modal) / len(test)) < 1e-12
