import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempograin.llm import quality_classifier as qc


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return qc.score_documents(docs, labels).join(labels, "doc_id").toPandas()


def test_held_out_accuracy(scored):
    assert (scored.held_out == scored.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    out = scored[scored.held_out]
    assert len(out) > 500
    good, bad = out[out.quality == 1], out[out.quality == 0]
    assert good.predicted.mean() > 0.98 and bad.predicted.mean() < 0.03
    wins = (good.score.to_numpy()[:, None] > bad.score.to_numpy()[None, :]).mean()
    assert wins > 0.995


def test_scores_equal_the_densities(spark, small_documents):
    """The discriminant written out with numpy on the same features."""
    df = spark.createDataFrame([(d, t) for d, t, _ in small_documents], "doc_id long, text string")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = qc.text_features(df).join(labels, "doc_id").toPandas()
    rows = rows[rows.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 != 0)]
    x, y = rows[qc.FEATURES].to_numpy(), rows.quality.to_numpy()
    scale, means, covs, n = x.std(0), {}, {}, len(x)
    for c in (0, 1):
        means[c], covs[c] = x[y == c].mean(0), np.cov(x[y == c].T, bias=True)
    within = sum((y == c).sum() * covs[c] for c in (0, 1)) / n
    every = qc.text_features(df).toPandas().sort_values("doc_id")[qc.FEATURES].to_numpy()
    logs = {}
    for c in (0, 1):
        m = (y == c).sum()
        w = qc.POOLED_ROWS / (qc.POOLED_ROWS + m)
        s = ((1 - w) * covs[c] + w * within) / np.outer(scale, scale)
        s = (1 - qc.SPHERE) * s + qc.SPHERE * np.trace(s) / len(s) * np.eye(len(s))
        z = (every - means[c]) / scale
        logs[c] = -0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z) - 0.5 * np.linalg.slogdet(s)[1] + np.log(m / n)
    want = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -50, 50)))
    got = qc.score_documents(df, labels).toPandas().sort_values("doc_id").score.to_numpy()
    assert np.allclose(got, want, atol=1e-6)


def test_odd_empty_and_one_sided(spark, odd, nothing):
    kind = "doc_id long, quality int"
    both = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(1, 1), (2, None), (3, 7)], kind)
    rows = qc.score_documents(odd, both).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [True]
    ones = qc.score_documents(odd, spark.createDataFrame([(i, 1) for i in range(12)], kind)).collect()
    assert {r.score for r in ones} == {1.0}
    assert {r.score for r in qc.score_documents(odd, both.limit(0)).collect()} == {0.5}
    assert qc.score_documents(nothing, both).count() == 0
    kept = qc.keep_good(odd, both)
    assert kept.columns == odd.columns
    want = sorted([r.doc_id for r in rows if r.predicted], key=repr)
    assert sorted([r.doc_id for r in kept.select(F.col("doc_id")).collect()], key=repr) == want
