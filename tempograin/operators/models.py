"""Model fits on leak-free folds with MLlib: the loop over folds is on the driver, the fits are not.

A penalty is stated as C (larger is weaker); MLlib's ``regParam`` is 1 / (C·n).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin.functions.numeric import portable_hash
from tempograin.operators import evaluation as ev
from tempograin.operators import boosting, newton
from tempograin.operators.ordered import join_same
from tempograin.session import durable

# The grid of C and the number of inner folds.
C_GRID = [0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0]
INNER_FOLDS = 3
# Shares of the training groups in a learning curve.
SHARES = [0.25, 0.5, 0.75, 1.0]
# Folds fitted at a time.
POOL = 4


def in_pool(one: Callable, cells: list) -> list:
    """``one`` of every cell, a few at a time, in the order of the cells."""
    with ThreadPool(POOL) as pool:
        return pool.map(one, cells, chunksize=1)


def boosted() -> GBTClassifier:
    """100 rounds at rate 0.1 of trees with 32 leaves at most, 20 rows a leaf and 255 bins."""
    return GBTClassifier(labelCol="label", maxIter=100, stepSize=0.1, maxDepth=5, minInstancesPerNode=20, maxBins=255, seed=0)


def preprocessor(numeric: list[str], categorical: list[str], missing: str = "explicit",
                 components: int | None = None) -> Pipeline:
    """Median impute, scale, one-hot and optionally PCA; fitted on training rows only.

    ``missing='mode'`` expects the level 'missing' to have been replaced by
    :func:`fill_mode`; 'explicit' keeps it as a level of its own.
    """
    stages, parts = [], []
    if numeric:
        filled = [f"{c}_filled" for c in numeric]
        stages += [Imputer(strategy="median", relativeError=1e-9, inputCols=numeric, outputCols=filled),
                   VectorAssembler(inputCols=filled, outputCol="_numbers"),
                   StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True)]
        last = "_scaled"
        if components:
            stages.append(PCA(k=min(components, len(numeric)), inputCol="_scaled", outputCol="_components"))
            last = "_components"
        parts.append(last)
    if categorical:
        indexed, hot = [f"{c}_index" for c in categorical], [f"{c}_hot" for c in categorical]
        stages += [StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=False, handleInvalid="keep")]
        parts += hot
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return Pipeline(stages=stages)


def fill_mode(train: DataFrame, df: DataFrame, categorical: list[str]) -> DataFrame:
    """Replace the level 'missing' by the training side's most frequent level."""
    known = train.agg(*[F.mode(F.when(F.col(c) != "missing", F.col(c)), True).alias(c) for c in categorical]).first()
    return df.withColumns({c: F.when(F.col(c) == "missing", F.lit(known[c])).otherwise(F.col(c)) for c in categorical})


def fit_logistic(train: DataFrame, group: str, grid: list[float] | None = None, inner: int = INNER_FOLDS):
    """Logistic regression with C chosen by grouped inner folds; returns (model, C)."""
    grid = grid or C_GRID
    n = train.count()
    base = LogisticRegression(labelCol="label", maxIter=100, standardization=False)
    if len(grid) == 1:
        return base.copy({base.regParam: 1.0 / (grid[0] * n)}).fit(train), grid[0]
    # A group never straddles inner folds: the fold is a hash of the group.
    folded = train.withColumn("_inner", (portable_hash(F.col(group), F.lit("inner")) % inner).cast("int"))
    params = ParamGridBuilder().addGrid(base.regParam, [1.0 / (c * n) for c in grid]).build()
    search = CrossValidator(estimator=base, estimatorParamMaps=params, numFolds=inner, foldCol="_inner", parallelism=4,
                            evaluator=BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC"))
    fitted = search.fit(folded)
    best = max(range(len(grid)), key=lambda i: (fitted.avgMetrics[i], -i))
    return fitted.bestModel, grid[best]


def fit_one(kind: str, train: DataFrame, group: str, grid: list[float] | None):
    if kind == "logit":
        return fit_logistic(train, group, grid)
    if kind == "boosted":
        return boosted().fit(train), None
    raise ValueError(f"unknown model family {kind!r}")


def score_folds(frame: DataFrame, assigned: DataFrame, group: str, row: str, numeric: list[str], categorical: list[str],
                kind: str = "logit", grid: list[float] | None = None, missing: str = "explicit",
                components: int | None = None, train_share: float = 1.0) -> tuple[DataFrame, list[dict]]:
    """Held-out scores of one model on every fold, and what was chosen per fold.

    All models of a study share ``assigned`` (seed, group, fold). ``train_share`` keeps
    that share of the training groups, ranked by a hash, for learning curves. Logistic models
    of all folds and penalties are fitted together, and so are boosted trees; only fold-wise
    mode filling and components, and shares of boosted trees, are fitted fold by fold.
    """
    if kind == "boosted" and missing == "explicit" and not components and train_share == 1.0:
        return boosting.score_folds(frame, assigned, group, row, numeric, categorical)
    if kind == "logit" and missing == "explicit" and not components:
        return newton.score_folds(frame, assigned, group, row, numeric, categorical, grid or C_GRID, INNER_FOLDS, train_share)
    data = durable(frame.join(assigned, group).withColumn("label", F.col("label").cast("double")))
    cells = sorted((r["seed"], r["fold"]) for r in data.select("seed", "fold").distinct().collect())

    def fit(cell):
        seed, fold = cell
        one = data.filter(F.col("seed") == seed)
        train, test = one.filter(F.col("fold") != fold), one.filter(F.col("fold") == fold)
        if train_share < 1.0:
            rank = portable_hash(F.lit(seed), F.lit(fold), F.col(group)) / float(2 ** 32)
            train = train.filter(rank < train_share)
        if train.select("label").distinct().count() < 2:
            return None
        if missing == "mode" and categorical:
            train, test = fill_mode(train, train, categorical), fill_mode(train, test, categorical)
        prep = preprocessor(numeric, categorical, missing, components).fit(train)
        prepared = durable(prep.transform(train).select(group, "label", "features"))
        model, c = fit_one(kind, prepared, group, grid)
        scored = model.transform(prep.transform(test)).select(
            F.lit(seed).alias("seed"), F.lit(fold).alias("fold"), row, F.col("label").cast("int").alias("y"),
            vector_to_array("probability")[1].alias("p"))
        return scored, {"seed": seed, "fold": fold, "c": c}
    done = [d for d in in_pool(fit, cells) if d is not None]
    outs, chosen = [d[0] for d in done], [d[1] for d in done]
    if not outs:
        raise ValueError("no fold had two classes to train on")
    return reduce(DataFrame.unionByName, outs), chosen


def calibration_slope(df: DataFrame, label: str, score: str) -> DataFrame:
    """Slope of the logit recalibration and the intercept of a constant model.

    The constant model's intercept is the logit of the base rate. The slope is one
    unpenalised logistic fit on one feature.
    """
    eps = 1e-6
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    rows = df.select(F.col(label).cast("double").alias("label"), F.log(p / (1 - p)).alias("_lp"))
    data = VectorAssembler(inputCols=["_lp"], outputCol="features").transform(rows)
    fit = LogisticRegression(labelCol="label", regParam=0.0, maxIter=200, tol=1e-10, standardization=False).fit(data)
    base = F.avg("label")
    return rows.agg(F.lit(float(fit.coefficients[0])).alias("slope"), F.log(base / (1 - base)).alias("intercept"))


def wave_accuracy(frame: DataFrame, assigned: DataFrame, group: str, wave: str, numeric: list[str]) -> DataFrame:
    """Can the features tell which wave a row came from? Accuracy per fold and the modal baseline.

    One softmax model a fold. Rows without a wave are left out; of equally frequent training
    waves the smallest is the baseline.
    """
    known = durable(frame.filter(F.col(wave).isNotNull()).select(group, wave, *numeric))
    waves = sorted(r[0] for r in known.select(wave).distinct().collect())  # a handful of years
    label = F.array_position(F.array(*[F.lit(w) for w in waves]), F.col(wave)).cast("int") - 1
    rows = known.withColumn("label", label).withColumn("_one", F.lit(0))
    scores, study = boosting.held_out_scores(rows, assigned, group, "_one", numeric, [], max(len(waves), 2))
    best = F.col("scores")[0] > 0 if len(waves) <= 2 else F.array_position("scores", F.array_max("scores")) - 1
    per = scores.groupBy("cell").agg(F.avg((best.cast("int") == F.col("y")).cast("double")).alias("accuracy"))
    fold_rows = join_same(rows.select(group, "label"), assigned.select(group, "seed", "fold"), [group])
    counts = fold_rows.groupBy("seed", "fold", "label").agg(F.count(F.lit(1)).alias("n"))
    cells = F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(int(s)).alias("seed"), F.lit(int(f)).alias("fold")) for i, (_, s, f) in enumerate(study.cells)])
    named = per.withColumn("_c", F.element_at(cells, F.col("cell") + 1)).select("_c.seed", "_c.fold", "accuracy")
    # Training rows of a fold are the seed's rows less the fold's own.
    whole = counts.groupBy("seed", "label").agg(F.sum("n").alias("whole"))
    each = named.join(whole, "seed").join(counts, ["seed", "fold", "label"], "left").withColumn("own", F.coalesce("n", F.lit(0)))
    modal = F.max_by("own", F.struct(F.col("whole") - F.col("own"), -F.col("label")))
    out = each.groupBy("seed", "fold", "accuracy").agg((modal / F.sum("own")).alias("baseline"))
    return out.withColumn("lift", F.col("accuracy") - F.col("baseline"))


def coefficient_ranking(frame: DataFrame, numeric: list[str], categorical: list[str], c: float = 1.0) -> DataFrame:
    """Standardised coefficients of one fit on all rows, for reading only, largest first."""
    data = frame.withColumn("label", F.col("label").cast("double"))
    prep = preprocessor(numeric, categorical).fit(data)
    prepared = prep.transform(data)
    model, _ = fit_logistic(prepared, "label", [c])
    attrs = prepared.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for part in attrs.values() for a in part}
    rows = [(names.get(i, str(i)), float(v)) for i, v in enumerate(model.coefficients)]
    rows.sort(key=lambda r: -abs(r[1]))
    return frame.sparkSession.createDataFrame([(i + 1, n, v) for i, (n, v) in enumerate(rows)], "position int, feature string, coefficient double")


def learning_curve(frame: DataFrame, assigned: DataFrame, group: str, row: str, numeric: list[str], categorical: list[str],
                   shares: list[float] | None = None, grid: list[float] | None = None) -> DataFrame:
    """Mean AUC over folds by share of training groups."""
    shares = shares or SHARES
    scores, _ = newton.score_variants(frame, assigned, group, row, numeric, categorical, grid or C_GRID, INNER_FOLDS, [newton.Variant(s) for s in shares])
    per = ev.auc(scores, ["variant", "seed", "fold"], "y", "p")
    share = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("variant") + 1).alias("share")
    return per.groupBy("variant").agg(F.avg("auc").alias("auc"), F.count("auc").alias("n_folds")).select(share, "auc", "n_folds")


def condition_suites(frame: DataFrame, assigned: DataFrame, group: str, row: str, condition: str, numeric: list[str],
                     categorical: list[str], min_rows: int, grid: list[float] | None = None) -> DataFrame:
    """One condition against the pool of rows with none, for every large enough condition."""
    sizes = frame.filter("label = 1").groupBy(condition).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows)
    found = [(r[condition], r["n"]) for r in sizes.orderBy(condition).collect()]  # a handful of named conditions
    if not found:
        raise ValueError(f"no condition has {min_rows} rows")
    variants = [newton.Variant(rows=(F.col("label") == 0) | F.col(condition).eqNullSafe(F.lit(name))) for name, _ in found]
    scores, _ = newton.score_variants(frame, assigned, group, row, numeric, categorical, grid or C_GRID, INNER_FOLDS, variants)
    per = ev.auc(scores, ["variant", "seed", "fold"], "y", "p").groupBy("variant").agg(F.avg("auc").alias("auc"))
    at = F.col("variant") + 1
    return per.select(F.element_at(F.array(*[F.lit(name) for name, _ in found]), at).alias("condition"),
                      F.element_at(F.array(*[F.lit(n) for _, n in found]), at).alias("n_positive"), "auc")
