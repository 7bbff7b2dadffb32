"""Logistic models of all folds and penalties in one pass per Newton step.

Every (seed, fold, inner fold, C) is a column of one coefficient matrix. A pass over the rows
adds up each model's loss, gradient and Hessian in the tasks; only these sums, whose size does
not depend on the rows, are summed by Spark and solved on the driver. Medians, means and
scales of all folds come from one aggregate of value counts. Scores of the inner folds are
counted per model in 1024 equal steps, from which the AUC that picks C is computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograin import session
from tempograin.functions.numeric import portable_hash
from tempograin.operators import evaluation as ev
from tempograin.operators.ordered import RunningSum, cut, join_same

SLICE = 8192  # rows a task works on together
STEPS = 60
SETTLED = 1e-7  # largest step of a model that has converged
BINS = 1024
LABEL = -1  # in the place of a column, the label's counts


@dataclass
class Study:
    """What all models share: the cells (variant, seed, fold), the features and how each cell prepares them."""

    cells: list[tuple[int, int, int]]
    numeric: list[str]
    levels: list[tuple[str, str]]
    grid: list[float]
    inner: int
    median: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    mean: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    scale: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    two_classes: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))

    @property
    def width(self) -> int:
        return 1 + len(self.numeric) + len(self.levels)

    def models(self) -> list[tuple[int, int, float]]:
        """(cell, inner fold left out or -1 for none, C) of every model."""
        return [(c, j, v) for c in range(len(self.cells)) for j in range(-1, self.inner if len(self.grid) > 1 else 0) for v in self.grid]

    def features(self, cell: int, x: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """The design matrix of some rows as ``cell`` prepares it, intercept first."""
        filled = np.where(np.isnan(x), self.median[cell], x)
        return np.concatenate([np.ones((len(x), 1)), (filled - self.mean[cell]) / self.scale[cell], hot], axis=1)


@dataclass
class Variant:
    """A study's training share of the groups, ranked by a hash, and the rows that take part (all if None)."""

    share: float = 1.0
    rows: Column | None = None


class Rows:
    """A slice of the stored rows as arrays."""

    def __init__(self, batch: pa.RecordBatch, study: Study):
        n = batch.num_rows

        def matrix(name: str, width: int) -> np.ndarray:
            column = batch.column(batch.schema.get_field_index(name))
            return pc.fill_null(column.flatten(), float("nan") if pa.types.is_floating(column.type.value_type) else 0).to_numpy(
                zero_copy_only=False).reshape(n, width)
        self.batch = batch
        self.x, self.hot = matrix("_x", len(study.numeric)), matrix("_hot", len(study.levels))
        self.y = batch.column(batch.schema.get_field_index("_y")).to_numpy()
        self.inner = batch.column(batch.schema.get_field_index("_inner")).to_numpy()
        self.role = matrix("_role", len(study.cells))  # 1 trains, 2 is tested


def _slices(batches: Iterator[pa.RecordBatch], study: Study) -> Iterator[Rows]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield Rows(batch.slice(at, SLICE), study)


def laid_out(frame: DataFrame, assigned: DataFrame, group: str, row: str, numeric: list[str], categorical: list[str],
             grid: list[float], inner: int, variants: list[Variant]) -> tuple[DataFrame, Study]:
    """The rows as arrays, written once, with their role in every cell."""
    cells = sorted((r["seed"], r["fold"]) for r in assigned.select("seed", "fold").distinct().collect())
    levels = [(c, r[0]) for c in categorical for r in frame.select(c).distinct().orderBy(c).collect() if r[0] is not None]
    own = assigned.groupBy(group).agg(*[F.max(F.when(F.col("seed") == s, F.col("fold"))).alias(f"_f{s}") for s in sorted({s for s, _ in cells})])
    role = []
    for variant in variants:
        for seed, fold in cells:
            trains = F.col(f"_f{seed}") != fold
            if variant.share < 1.0:
                trains = trains & (portable_hash(F.lit(seed), F.lit(fold), F.col(group)) / float(2 ** 32) < variant.share)
            role.append(F.when(F.col(f"_f{seed}") == fold, 2).when(trains, 1).otherwise(0).cast("tinyint"))
    own_roles = [F.slice("_role", v * len(cells) + 1, len(cells)) for v in range(len(variants))]
    absent = F.array_repeat(F.lit(0).cast("tinyint"), len(cells))
    roles = F.concat(*[r if v.rows is None else F.when(F.col(f"_part{i}"), r).otherwise(absent)
                       for i, (v, r) in enumerate(zip(variants, own_roles))])
    # Inner folds are dealt by label mix and size of the groups as well; a group is in one of them.
    dealt = ev.assign_folds(frame, group, "label", [0], inner).select(group, F.col("fold").alias("_inner"))
    groups = join_same(own, dealt, [group]).select(group, "_inner", F.array(*role).alias("_role"))
    hot = [(F.col(c) == F.lit(v)).cast("double") for c, v in levels]
    rows = frame.filter(F.col("label").isNotNull()).select(
        F.col(group), F.col(row).alias("_row"), F.col("label").cast("double").alias("_y"),
        F.array(*[F.col(c).cast("double") for c in numeric]).cast("array<double>").alias("_x"),
        F.array(*[F.coalesce(h, F.lit(0.0)) for h in hot]).cast("array<double>").alias("_hot"),
        *[F.coalesce(v.rows, F.lit(False)).alias(f"_part{i}") for i, v in enumerate(variants) if v.rows is not None])
    data = join_same(rows, groups, [group]).withColumn("_role", roles).select("_row", "_y", "_x", "_hot", "_inner", "_role")
    return session.durable(data), Study([(v, *c) for v in range(len(variants)) for c in cells], numeric, levels, grid, inner)


def prepare(data: DataFrame, study: Study, low: bool = False) -> None:
    """Each cell's medians, means and scales over its training rows, and whether these have two classes.

    The median of an even number of values is the mean of the middle two, or with ``low`` the smaller one.
    """
    n_cells, n = len(study.cells), len(study.numeric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches, study):
            out: list[tuple[np.ndarray, ...]] = []
            for column, values in ((LABEL, rows.y), *enumerate(rows.x.T)):
                found, place = np.unique(values, return_inverse=True)  # sorted once for all cells
                for cell in range(n_cells):
                    counts = np.bincount(place[rows.role[:, cell] == 1], minlength=len(found))
                    seen = np.flatnonzero(counts)
                    out.append((np.full(len(seen), cell, np.int32), np.full(len(seen), column, np.int32), found[seen], counts[seen]))
            cell, column, value, k = (np.concatenate(v) for v in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(column), pa.array(value, mask=np.isnan(value)), pa.array(k, pa.int64())],
                names=["cell", "column", "value", "n"])
    counted = session.durable(data.mapInArrow(run, "cell int, column int, value double, n long").groupBy(
        "cell", "column", "value").agg(F.sum("n").alias("n")))
    v, k = F.col("value"), F.col("n")
    sums = counted.groupBy("cell", "column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(v.isNull(), k).otherwise(0)).alias("none"), F.sum(v * k).alias("sum"),
        F.sum(v * v * k).alias("squares"), F.count_if(v.isNotNull()).alias("kinds"))
    ranked = cut(counted.filter(v.isNotNull()), ["cell", "column"], ["value"]).add(_cum=RunningSum(k)).rows()
    at = (F.col("rows") - F.col("none") - 1) / 2
    middle = ranked.join(sums.select("cell", "column", "rows", "none"), ["cell", "column"]).groupBy("cell", "column").agg(
        F.min(F.when(F.col("_cum") > F.floor(at), v)).alias("lo"), F.min(F.when(F.col("_cum") > F.ceil(at), v)).alias("hi"))
    study.median, study.mean, study.scale = np.zeros((n_cells, n)), np.zeros((n_cells, n)), np.ones((n_cells, n))
    study.two_classes = np.zeros(n_cells, bool)
    for r in sums.join(middle, ["cell", "column"], "left").collect():  # one row per cell and feature
        if r["column"] == LABEL:
            study.two_classes[r["cell"]] = r["kinds"] > 1
            continue
        at, median = (r["cell"], r["column"]), 0.0 if r["lo"] is None else r["lo"] if low else (r["lo"] + r["hi"]) / 2
        mean = ((r["sum"] or 0.0) + r["none"] * median) / r["rows"]
        spread = ((r["squares"] or 0.0) + r["none"] * median * median) / r["rows"] - mean * mean
        study.median[at], study.mean[at] = median, mean
        study.scale[at] = np.sqrt(spread) if spread > 1e-12 * max(1.0, mean * mean) else 1.0


def _logistic(eta: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(eta, -500, 500)))


def sums_of(data: DataFrame, study: Study, models: list[tuple[int, int, float]], beta: np.ndarray, active: list[int],
            curved: bool = True) -> np.ndarray:
    """(active model, sums): gradient and, if ``curved``, upper Hessian and loss of each, without the penalty."""
    k = study.width
    up, across = np.triu_indices(k)
    size = k + len(up) + 1 if curved else k
    by_part: dict[tuple[int, int], list[int]] = {}  # models by cell and by each inner fold they train on
    for place, m in enumerate(active):
        for j in range(study.inner):
            if models[m][1] != j:
                by_part.setdefault((models[m][0], j), []).append(place)
    columns = beta[active].T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(active), size))
        for rows in _slices(batches, study):
            for (cell, j), places in by_part.items():
                chosen = np.flatnonzero((rows.role[:, cell] == 1) & (rows.inner == j))
                if not len(chosen):
                    continue
                z, y = study.features(cell, rows.x[chosen], rows.hot[chosen]), rows.y[chosen][:, None]
                eta = z @ columns[:, places]
                e = np.exp(-np.abs(eta))
                larger = 1.0 / (1.0 + e)
                p = np.where(eta >= 0, larger, e * larger)
                total[places, :k] += (p - y).T @ z
                if curved:
                    total[places, k:-1] += (e * larger * larger).T @ (z[:, up] * z[:, across])
                    total[places, -1] += (np.maximum(eta, 0) - np.log(larger) - y * eta).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(active)), size)), pa.array(np.tile(np.arange(size), len(active))), pa.array(total.ravel())],
            names=["model", "place", "value"])
    found = data.mapInArrow(run, "model long, place long, value double").groupBy("model", "place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros((len(active), size))
    out[found["model"].to_numpy(), found["place"].to_numpy()] = found["value"].to_numpy()
    return out


def _penalty(study: Study, c: float) -> np.ndarray:
    weight = np.full(study.width, 1.0 / c)
    weight[0] = 0.0
    return weight


def _newton(data: DataFrame, study: Study, beta: np.ndarray, active: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Damped Newton steps of the ``active`` models, into ``beta``; the last point, gradient and Hessian of each, unpenalised."""
    models, k = study.models(), study.width
    up, across = np.triu_indices(k)
    step, best = np.zeros((len(models), k)), np.full(len(models), np.inf)
    last = {}
    for _ in range(STEPS):
        if not active:
            break
        left = []
        for m, s in zip(active, sums_of(data, study, models, beta, active)):
            weight = _penalty(study, models[m][2])
            value = s[-1] + 0.5 * (weight * beta[m] ** 2).sum()
            if value > best[m] + 1e-9 * abs(best[m]):  # too far: half of the way back
                step[m] /= 2
                beta[m] -= step[m]
                left.append(m)
                continue
            best[m] = value
            hessian = np.zeros((k, k))
            hessian[up, across] = s[k:-1]
            hessian = np.triu(hessian) + np.triu(hessian, 1).T
            last[m] = beta[m].copy(), s[:k], hessian
            step[m] = _solved(hessian, weight, s[:k], beta[m])
            beta[m] += step[m]
            if np.abs(step[m]).max() > SETTLED:
                left.append(m)
        active = left
    return last


def _solved(hessian: np.ndarray, weight: np.ndarray, gradient: np.ndarray, at: np.ndarray) -> np.ndarray:
    return -np.linalg.solve(hessian + np.diag(weight + 1e-10), gradient + weight * at)


def fit(data: DataFrame, study: Study) -> np.ndarray:
    """The coefficients of all models: least loss + ||w||² / (2C), intercept free, by damped Newton steps.

    Models that differ in C alone share their rows, and with many rows lie close together. The middle C goes
    first; from its last Hessian the others take steps that need a gradient only. One whose steps do not
    shrink fast goes on with Newton steps of its own.
    """
    models, n = study.models(), len(study.grid)
    beta = np.zeros((len(models), study.width))
    lead = {m: m - m % n + n // 2 for m, (cell, _, _) in enumerate(models) if study.two_classes[cell]}
    last = _newton(data, study, beta, sorted(set(lead.values())))
    active, size, alone = [], {}, []
    for m, first in lead.items():
        if m != first:
            at, gradient, hessian = last[first]
            beta[m] = at + _solved(hessian, _penalty(study, models[m][2]), gradient, at)
            active.append(m)
    while active:
        left = []
        for m, gradient in zip(active, sums_of(data, study, models, beta, active, curved=False)):
            step = _solved(last[lead[m]][2], _penalty(study, models[m][2]), gradient, beta[m])
            size[m], before = np.abs(step).max(), size.get(m, np.inf)
            beta[m] += step
            if not size[m] <= before / 4:
                alone.append(m)
            elif size[m] > SETTLED:
                left.append(m)
        active = left
    for m in alone:
        beta[m] = beta[lead[m]]
    _newton(data, study, beta, alone)
    return beta


def choose(data: DataFrame, study: Study, beta: np.ndarray) -> list[int]:
    """The place in the grid with the best mean AUC over the inner folds, for every cell; the first of equals."""
    if len(study.grid) == 1:
        return [0] * len(study.cells)
    number = {m: i for i, m in enumerate(study.models())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(number), BINS, 2), np.int64)
        for rows in _slices(batches, study):
            for cell in range(len(study.cells)):
                for j in range(study.inner):
                    chosen = (rows.role[:, cell] == 1) & (rows.inner == j)
                    if not chosen.any():
                        continue
                    own = [number[cell, j, c] for c in study.grid]
                    p = _logistic(study.features(cell, rows.x[chosen], rows.hot[chosen]) @ beta[own].T)
                    place = np.minimum((p * BINS).astype(np.int64), BINS - 1) * 2 + rows.y[chosen].astype(np.int64)[:, None]
                    for i, m in enumerate(own):
                        counts[m] += np.bincount(place[:, i], minlength=2 * BINS).reshape(BINS, 2)
        model, score = np.nonzero(counts.sum(axis=2))
        yield pa.RecordBatch.from_arrays(
            [pa.array(model), pa.array(score), pa.array(counts[model, score, 1]), pa.array(counts[model, score, 0])], names=["model", "score", "pos", "neg"])
    counted = session.durable(data.mapInArrow(run, "model long, score long, pos long, neg long").groupBy("model", "score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    auc = {r["model"]: r["auc"] for r in ev.auc_from_counts(counted, ["model"]).collect()}  # one row per model
    out = []
    for cell in range(len(study.cells)):
        means = []
        for c in study.grid:
            each = [a for j in range(study.inner) if (a := auc.get(number[cell, j, c])) is not None]
            means.append(round(sum(each) / len(each), 12) if each else -1.0)
        out.append(int(np.argmax(means)))
    return out


def score_variants(frame: DataFrame, assigned: DataFrame, group: str, row: str, numeric: list[str], categorical: list[str],
                   grid: list[float], inner: int, variants: list[Variant]) -> tuple[DataFrame, list[dict]]:
    """(variant, seed, fold, row, y, p) of every held-out row, and the C chosen for each fold; all variants in the same passes.

    Rows with a null label are left out; a null group is a group. Null numbers take the
    training median; a feature that is null or constant in training is zero. Levels that
    training lacks, and null ones, count as none. Folds whose training rows have one class are
    left out; if all are, it is an error.
    """
    data, study = laid_out(frame, assigned, group, row, numeric, categorical, grid, inner, variants)
    prepare(data, study)
    if not study.two_classes.any():
        raise ValueError("no fold had two classes to train on")
    beta = fit(data, study)
    chosen = choose(data, study, beta)
    number = {m: i for i, m in enumerate(study.models())}
    final = np.array([beta[number[cell, -1, grid[c]]] for cell, c in enumerate(chosen)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches, study):
            for cell in np.flatnonzero(study.two_classes):
                at = np.flatnonzero(rows.role[:, cell] == 2)
                p = _logistic(study.features(cell, rows.x[at], rows.hot[at]) @ final[cell])
                where = [pa.array(np.full(len(at), v), pa.int32()) for v in study.cells[cell]]
                yield pa.RecordBatch.from_arrays(
                    [*where, rows.batch.column(rows.batch.schema.get_field_index("_row")).take(pa.array(at)),
                     pa.array(rows.y[at].astype(np.int32)), pa.array(p)], names=["variant", "seed", "fold", row, "y", "p"])
    kind = frame.schema[row].dataType.simpleString()
    scores = data.mapInArrow(run, f"variant int, seed int, fold int, {row} {kind}, y int, p double")
    told = [{"variant": v, "seed": s, "fold": f, "c": grid[chosen[i]]} for i, (v, s, f) in enumerate(study.cells) if study.two_classes[i]]
    return scores, told


def score_folds(frame: DataFrame, assigned: DataFrame, group: str, row: str, numeric: list[str], categorical: list[str],
                grid: list[float], inner: int, train_share: float = 1.0) -> tuple[DataFrame, list[dict]]:
    """(seed, fold, row, y, p) of every held-out row, and the C chosen for each fold: one variant."""
    scores, told = score_variants(frame, assigned, group, row, numeric, categorical, grid, inner, [Variant(train_share)])
    return scores.drop("variant"), [{k: v for k, v in t.items() if k != "variant"} for t in told]


def _axes(spark: SparkSession, covariance: np.ndarray, components: int) -> np.ndarray:
    """MLlib's principal axes, with its signs, of a few rows that have this covariance."""
    k = len(covariance)
    values, vectors = np.linalg.eigh(covariance)
    half = (vectors * np.sqrt(np.maximum(values, 0) * (2 * k - 1) / 2)).T
    rows = spark.createDataFrame([(Vectors.dense(v),) for v in np.concatenate([half, -half])], ["x"]).coalesce(1)
    return PCA(k=components, inputCol="x", outputCol="y").fit(rows).pc.toArray()


def prepared_folds(frame: DataFrame, assigned: DataFrame, group: str, row: str, numeric: list[str], categorical: list[str],
                   components: int) -> DataFrame:
    """(seed, fold, row, features) of every held-out row as its fold's training rows prepare it, all folds in the same passes.

    The features are ``components`` principal components of the imputed and scaled numbers, then for each category
    the levels seen in training, one for any other and one that stays empty, as MLlib's stages give them.
    """
    data, study = laid_out(frame, assigned, group, row, numeric, categorical, [1.0], 1, [Variant()])
    prepare(data, study, low=True)
    n, k = len(study.cells), len(numeric)
    size = 1 + k * k + len(study.levels)

    def centred(cell: int, x: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), study.median[cell], x) - study.mean[cell]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, size))
        for rows in _slices(batches, study):
            for cell in range(n):
                chosen = rows.role[:, cell] == 1
                z = centred(cell, rows.x[chosen])
                total[cell] += np.concatenate([[len(z)], (z.T @ z).ravel(), rows.hot[chosen].sum(axis=0)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(n), size)), pa.array(np.tile(np.arange(size), n)), pa.array(total.ravel())], names=["cell", "place", "value"])
    found = data.mapInArrow(sums, "cell long, place long, value double").groupBy("cell", "place").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros((n, size))
    total[found["cell"].to_numpy(), found["place"].to_numpy()] = found["value"].to_numpy()
    known = total[:, 1 + k * k:] > 0

    def turn(t: np.ndarray) -> np.ndarray:
        spread = t[1:1 + k * k].reshape(k, k) / max(t[0] - 1, 1)
        deviation = np.sqrt(np.diag(spread))
        inverse = np.where(deviation > 0, 1 / np.where(deviation > 0, deviation, 1), 0)
        return inverse[:, None] * _axes(frame.sparkSession, spread * inverse * inverse[:, None], min(components, k))
    with ThreadPool(8) as pool:
        turns = pool.map(turn, total, chunksize=1)
    names = np.array([c for c, _ in study.levels])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _slices(batches, study):
            for cell in range(n):
                at = np.flatnonzero(rows.role[:, cell] == 2)
                parts = [centred(cell, rows.x[at]) @ turns[cell]]
                for c in categorical:
                    hot = rows.hot[at][:, np.flatnonzero((names == c) & known[cell])]
                    parts += [hot, 1 - hot.sum(axis=1, keepdims=True), np.zeros((len(at), 1))]
                made = np.concatenate(parts, axis=1)
                features = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * made.shape[1], pa.int32()), pa.array(made.ravel()))
                where = [pa.array(np.full(len(at), v), pa.int32()) for v in study.cells[cell][1:]]
                yield pa.RecordBatch.from_arrays(
                    [*where, rows.batch.column(rows.batch.schema.get_field_index("_row")).take(pa.array(at)), features],
                    names=["seed", "fold", row, "features"])
    kind = frame.schema[row].dataType.simpleString()
    return data.mapInArrow(run, f"seed int, fold int, {row} {kind}, features array<double>")
