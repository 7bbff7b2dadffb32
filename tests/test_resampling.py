"""Resampling of known points against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tempograin.functions import arrays


def test_resampling_equals_interpolation(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        lo, hi = 10, 10 + int(rng.integers(1, 40))
        frames = sorted(rng.choice(np.arange(5, 55), int(rng.integers(0, 12)), replace=False).tolist())
        rows.append((k, lo, hi, [(f, float(v)) for f, v in zip(frames, np.round(rng.normal(0, 50, len(frames)), 2))]))
    # All points before the span, all after it, and a span without length.
    rows += [(100, 10, 20, [(1, 1.0), (4, 5.0)]), (101, 10, 20, [(30, 1.0), (40, 5.0)]), (102, 10, 10, [(8, 1.0), (10, 5.0), (12, 6.0)])]
    df = spark.createDataFrame(rows, "k long, lo long, hi long, points array<struct<frame: long, value: double>>")
    out = df.select("k", arrays.resample_known(F.col("points"), F.col("lo"), F.col("hi"), 101).alias("curve"))
    got = {r["k"]: r["curve"] for r in out.collect()}
    for k, lo, hi, points in rows:
        if len(points) < 2:
            assert got[k] is None
            continue
        x = lo + (hi - lo) * np.arange(101) / 100
        np.testing.assert_allclose(got[k], np.interp(x, *zip(*points)), atol=1e-9)


def test_no_grid_point_searches_all_points(spark):
    df = spark.range(1).select(F.expr("array(named_struct('frame', 1L, 'value', 2.0D))").alias("points"), F.lit(0).cast("long").alias("lo"), F.lit(9).cast("long").alias("hi"))
    out = df.select(arrays.resample_known(F.col("points"), F.col("lo"), F.col("hi"), 101).alias("curve"))
    assert "filter(" not in out._jdf.queryExecution().analyzed().toString()
