"""Model queries on the cohort, and the streaming ingest of its documents.

They run the whole protocol: five seeds of five folds, C chosen from seven values by three
grouped inner folds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin.functions.numeric import r6
from tempograin.operators import curves
from tempograin.operators import evaluation as ev
from tempograin.operators import models as ops
from tempograin.operators import newton
from tempograin.plans import audit as audit_plans
from tempograin.plans import sources as source_plans
from tempograin.plans.cohort import cohort
from tempograin.plans.curves import doubles
from tempograin.plans.evaluation import SCORED, scored
from tempograin.plans.registry import query
from tempograin.session import scratch_path
from tempograin.sources import documents as docs
from tempograin.sources import sinks
from tempograin.sources.tables import Tables
from tempograin.streaming import ingest

NUMERIC = ["age", "height", "weight", "speed"]
CATEGORICAL = ["gender"]


def frame(t: Tables) -> DataFrame:
    """Labelled sessions with the study's features."""
    return cohort(t).filter(F.col("label").isNotNull()).select("filename", "sub_id", "wave", "injury", "label", *NUMERIC, "years_missing", *CATEGORICAL, "level")


def study(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The sessions, cleaned once and read back, and their folds."""
    rows = sinks.rewritten_parquet(frame(t), "cohort")
    return rows, ev.assign_folds(rows, "sub_id", "label")


@query("e03_preprocessing")
def _(t):
    """Imputed, scaled and one-hot features with three components of each outer fold, fitted on its training side."""
    rows = newton.prepared_folds(*study(t), "sub_id", "filename", NUMERIC, CATEGORICAL, 3)
    return rows.withColumn("features", F.transform("features", lambda v: F.round(v, 6) + 0.0))


@query("e04_inner_choice")
def _(t):
    """The C that grouped inner folds choose for each outer fold."""
    _, chosen = ops.score_folds(*study(t), "sub_id", "filename", NUMERIC, CATEGORICAL)
    return t.spark.createDataFrame(chosen, "seed int, fold int, c double")


@query("e05_fold_scores")
def _(t):
    scores, _ = ops.score_folds(*study(t), "sub_id", "filename", NUMERIC, CATEGORICAL)
    return scores.withColumn("p", r6(F.col("p")))


@query("e05_boosted_scores")
def _(t):
    scores, _ = ops.score_folds(*study(t), "sub_id", "filename", NUMERIC, CATEGORICAL, kind="boosted")
    return scores.withColumn("p", r6(F.col("p")))


def _newton_sql(steps: int = 12) -> str:
    """Logistic regression on one feature by unrolled Newton steps."""
    parts = ["n0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for i in range(steps):
        parts.append(f"""g{i} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(y - m) AS ga, sum((y - m) * x) AS gb, sum(m * (1 - m)) AS haa, sum(m * (1 - m) * x) AS hab, sum(m * (1 - m) * x * x) AS hbb
  FROM (SELECT y, x, a, b, 1 / (1 + exp(-(a + b * x))) AS m FROM lx, n{i})),
n{i + 1} AS (SELECT a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM g{i})""")
    return ", ".join(parts)


@query("e15_calibration_slope", f"""WITH {SCORED}, lx AS (SELECT y, ln(p / (1 - p)) AS x FROM scored), {_newton_sql()}
SELECT round(max(b), 4) AS slope, round((SELECT ln(avg(y) / (1 - avg(y))) FROM lx), 6) AS intercept FROM n12""")
def _(t):
    out = ops.calibration_slope(scored(t), "y", "p")
    return out.select(F.round("slope", 4).alias("slope"), r6(F.col("intercept")).alias("intercept"))


@query("e19_learning_curve")
def _(t):
    out = ops.learning_curve(*study(t), "sub_id", "filename", NUMERIC, CATEGORICAL)
    return out.withColumn("auc", r6(F.col("auc")))


@query("e20_wave_recoverability")
def _(t):
    """Five folds of the first seed."""
    rows, folds = study(t)
    out = ops.wave_accuracy(rows, folds.filter(F.col("seed") == ev.SEEDS[0]), "sub_id", "wave", [*NUMERIC, "years_missing"])
    return out.select("seed", "fold", *[r6(F.col(c)).alias(c) for c in ("accuracy", "baseline", "lift")])


@query("e33_condition_suites")
def _(t):
    out = ops.condition_suites(*study(t), "sub_id", "filename", "injury", NUMERIC, CATEGORICAL, 35)
    return out.withColumn("auc", r6(F.col("auc")))


@query("e35_convention_sensitivity")
def _(t):
    """Rescale the residual bank and rescore: one AUC per residual scale."""
    c = doubles(t).withColumn("pair", F.floor(F.col("vec_id") / 2))
    even = c.filter("vec_id % 2 = 0").select("pair", F.col("curve").alias("l"), (F.col("label") >= 5).cast("int").alias("label"))
    pairs = even.join(c.filter("vec_id % 2 = 1").select("pair", F.col("curve").alias("r")), "pair")
    bank = pairs.select(F.col("pair").alias("clip"), F.transform("l", lambda v: v * 0.1).alias("near"), F.transform("r", lambda v: v * 0.1).alias("far"))
    folds = ev.assign_folds(pairs, "pair", "label")
    names = [f"d{i}" for i in range(4)]
    outs = None
    for scale in (0.5, 1.0, 2.0):
        moved = curves.perturb_from_bank(pairs, bank, "pair", 5, scale)
        diff = F.zip_with("r_moved", "l_moved", lambda a, b: a - b)
        feats = moved.withColumn("_d", diff).select("pair", F.col("pair").alias("row"), "label", *[
            F.aggregate(F.slice("_d", 16 * i + 1, 16), F.lit(0.0), lambda s, v: s + v).alias(n) for i, n in enumerate(names)])
        scores, _ = ops.score_folds(feats, folds, "pair", "row", names, [])
        one = ev.auc(scores, ["seed", "fold"], "y", "p").agg(F.lit(scale).alias("scale"), r6(F.avg("auc")).alias("auc"))
        outs = one if outs is None else outs.unionByName(one)
    return outs


@query("e36_coefficients")
def _(t):
    return ops.coefficient_ranking(frame(t), NUMERIC, [*CATEGORICAL, "level"]).withColumn("coefficient", r6(F.col("coefficient")))


@query("r01_stream_documents", f"""WITH {source_plans.DOCS}, g AS (SELECT * FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 5 <> 0)
SELECT s_suppkey, 'left_SPEED' AS key, s_nationkey::DOUBLE AS value FROM g UNION ALL SELECT s_suppkey, 'right_SPEED', s_nationkey + 1 FROM g UNION ALL SELECT s_suppkey, 'right_CAD', 2.5 FROM g""")
def _(t):
    out, checkpoint = ingest.work_folders(t.spark, "stream")
    rows = ingest.ingest_documents(t.spark, source_plans.document_folder(t), out, checkpoint)
    return rows.filter(~F.col("dropped")).select(docs.path_key(F.col("path"), "s_suppkey").cast("long").alias("s_suppkey"), "key", "value")


@query("r03_stream_errors", f"SELECT s_suppkey, {source_plans.STATUS} AS err FROM supplier WHERE s_suppkey % 9 = 0 OR s_suppkey % 5 = 0")
def _(t):
    """The documents that the stream could not take, and why."""
    out, checkpoint = ingest.work_folders(t.spark, "errors")
    rows = ingest.ingest_documents(t.spark, source_plans.document_folder(t), out, checkpoint)
    return rows.filter("err <> ''").select(docs.path_key(F.col("path"), "s_suppkey").cast("long").alias("s_suppkey"), "err")


@query("r02_stream_checks", f"""WITH {audit_plans.CHECKS}
SELECT clip, CASE WHEN bool_or(status = 'refuse') THEN 'refuse' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END AS verdict FROM ck GROUP BY 1""")
def _(t):
    rows = audit_plans.clips(t)
    folder = scratch_path(t.spark, "clips")
    rows.write.parquet(folder)
    out, checkpoint = ingest.work_folders(t.spark, "checks")
    return ingest.check_clips(t.spark, folder, rows.schema, out, checkpoint).select("clip", "verdict")
