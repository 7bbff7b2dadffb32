"""Model folds and streaming ingest end to end on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempograin.operators import evaluation as ev
from tempograin.operators import models
from tempograin.operators.windows import apply_windows
from tempograin.sources import documents as docs
from tempograin.streaming import ingest


def test_fold_scores_recover_a_signal(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 40), float(x), "a" if i % 3 else "missing", int(x + rng.normal(0, 0.5) > 0)) for i, x in enumerate(rng.normal(size=240))]
    df = spark.createDataFrame(rows, "row bigint, subject bigint, x double, c string, label int")
    folds = ev.assign_folds(df, "subject", "label", [11], 2)
    scores, chosen = models.score_folds(df, folds, "subject", "row", ["x"], ["c"], grid=[0.1, 1.0], missing="mode")
    assert scores.count() == 240 and {c["c"] for c in chosen} <= {0.1, 1.0}
    assert ev.auc(scores, [], "y", "p").first()["auc"] > 0.8


def test_documents_are_ingested_once(spark):
    doc = '{"dv_r": {"left": {"K": %d}, "right": []}}'
    first = spark.range(3).select(F.format_string(doc, "id").alias("doc"))
    folder = docs.write_one_per_file(first, "doc", "once")
    out, checkpoint = ingest.work_folders(spark, "once")
    assert ingest.ingest_documents(spark, folder, out, checkpoint).count() == 3
    assert ingest.ingest_documents(spark, folder, out, checkpoint).count() == 3
    spark.range(3, 5).select(F.format_string(doc, "id").alias("doc")).write.mode("append").option("maxRecordsPerFile", 1).text(folder)
    got = ingest.ingest_documents(spark, folder, out, checkpoint)
    assert sorted(r["value"] for r in got.collect()) == [0, 1, 2, 3, 4]


def test_documents_that_fail_are_rows_with_a_reason(spark):
    texts = ['{"dv_r": {"left": {"K": 1}, "right": []}}', '{"dv_r": ', '{"dv_r": []}', '{"a": 1}', "null"]
    rows = spark.createDataFrame([(t,) for t in texts], "doc string")
    folder = docs.write_one_per_file(rows, "doc", "failing")
    got = ingest.ingest_documents(spark, folder, *ingest.work_folders(spark, "failing"))
    assert sorted(r["err"] for r in got.collect()) == [
        "", "block is empty", "block missing", "block missing", "not valid JSON"]
    assert {r["err"] == "" for r in got.filter("not dropped").collect()} == {True}


def test_header_levels_read_no_further_than_the_head(spark):
    texts = ['{"hz_w": 120, "hz_r": []}', '{"hz_w": 120.5, "hz_r": 200}', '{"hz_w": 120}',
             '{"x": "%s", "hz_w": 120, "hz_r": 200}' % ("é" * 4096)]
    folder = docs.write_one_per_file(spark.createDataFrame([(t,) for t in texts], "doc string"), "doc", "heads")
    assert {len(r["head"]) <= docs.HEADER_BYTES for r in docs.file_heads(spark, folder).collect()} == {True}
    got = {(r["hz_w"], r["hz_r"], r["matched"]): r["n"] for r in docs.header_survey(spark, folder, ["hz_w", "hz_r"]).collect()}
    assert got == {("120", "[]", True): 1, ("120.5", "200", True): 1, (None, None, False): 2}


@pytest.mark.parametrize("n", [1, 5, 8, 9, 17, 40])
def test_window_blend_of_the_identity_is_the_series(spark, n):
    df = spark.createDataFrame([(1, i, float(i * i)) for i in range(n)], "k int, frame bigint, v double")
    out = apply_windows(df, ["k"], "v", lambda w: w, 8).orderBy("frame").collect()
    np.testing.assert_allclose([r["blended"] for r in out], [i * i for i in range(n)], atol=1e-9)
