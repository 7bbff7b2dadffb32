"""Series operators against a sequential definition and known answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempograin.operators import series as ops

K = ["clip"]


def frame(spark, *series):
    rows = [(c, i, None if v is None else float(v)) for c, s in enumerate(series) for i, v in enumerate(s)]
    return spark.createDataFrame(rows, "clip int, frame bigint, value double")


def knee(cycles, fps=30.0, period=0.75, phase=0.0):
    n = int(cycles * period * fps)
    return [20 + 60 * 0.5 * (1 - math.cos(2 * math.pi * ((i / fps) / period + phase))) for i in range(n)]


def sequential_events(values):
    """The trigger walked one value at a time."""
    known = [v for v in values if v is not None]
    if len(known) < 4:
        return []
    lo, hi = np.percentile(known, [5, 95])
    if hi - lo < 1e-9:
        return []
    low, high = (lo + hi) / 2 - 0.125 * (hi - lo), (lo + hi) / 2 + 0.125 * (hi - lo)
    found, best, best_at, inside = [], None, None, False
    for i, v in enumerate(values):
        if v is None:
            continue
        if not inside and v > high:
            inside, best, best_at = True, v, i
        elif inside and v < low:
            found.append(best_at)
            inside = False
        elif inside and v > best:
            best, best_at = v, i
    return found


@pytest.mark.parametrize("rows", [0, 40])
def test_events_equal_the_sequential_walk(spark, chunked, rows):
    rng = np.random.default_rng(5)
    cases = [[None if rng.random() < 0.1 else round(float(v), 1) for v in rng.normal(0, 10, n)] for n in (3, 4, 30, 200, 61)]
    cases += [[7.0] * 20, [None] * 12, [5.0], knee(6), [1, 1, 9, 9, 9, 1, 1, 9, 9]]
    if rows:
        chunked(rows)
    got = {}
    for r in ops.hysteresis_events(frame(spark, *cases), K).collect():
        got.setdefault(r["clip"], []).append(r["frame"])
    for i, case in enumerate(cases):
        assert sorted(got.get(i, [])) == sequential_events(case), i


def test_counts_of_a_clean_trace(spark):
    ev = ops.hysteresis_events(frame(spark, knee(8), knee(5)), K)
    assert {r["clip"]: r["count"] for r in ev.groupBy("clip").count().collect()} == {0: 8, 1: 5}


def test_gap_at_the_limit_is_filled_and_one_longer_is_not(spark):
    def gapped(width):
        return [0.0] + [None] * width + [10.0, 11.0]
    out = ops.fill_short_gaps(frame(spark, gapped(6), gapped(7), [None, 1.0, 2.0, None]), K, 30.0)
    left = {r["clip"]: r["n"] for r in out.groupBy("clip").agg(F.count_if(F.col("filled").isNull()).alias("n")).collect()}
    assert left == {0: 0, 1: 7, 2: 2}
    line = [r["filled"] for r in out.filter("clip = 0").orderBy("frame").collect()]
    np.testing.assert_allclose(line[:8], np.linspace(0, 10, 8))


def test_verdict_accepts_alternating_legs_and_names_failures(spark):
    good = [("a", "L", i, v) for i, v in enumerate(knee(8))] + [("a", "R", i, v) for i, v in enumerate(knee(8, phase=0.5))]
    flat = [("b", "L", i, 30.0) for i in range(100)] + [("b", "R", i, v) for i, v in enumerate(knee(8))]
    df = spark.createDataFrame(good + flat, "clip string, side string, frame bigint, value double")
    out = {r["clip"]: r for r in ops.segmentation_verdict(df, "clip", "side", 30.0).collect()}
    assert out["a"]["ok"] and out["a"]["reasons"] == []
    assert not out["b"]["ok"]
    assert "l: swing too small" in out["b"]["reasons"] and "sides disagree on the count" in out["b"]["reasons"]


def test_dominant_period_of_a_sine(spark):
    s = [math.sin(2 * math.pi * i / 20) for i in range(200)]
    assert ops.dominant_period(frame(spark, s, [1.0] * 50, s[:5]), K, 9, 60).orderBy("clip").collect()[0]["period"] == 20
    rest = ops.dominant_period(frame(spark, s, [1.0] * 50, s[:5]), K, 9, 60).filter("clip > 0").collect()
    assert [r["period"] for r in rest] == [None, None]


def test_contacts_cut_by_the_ends_do_not_count(spark):
    s = [9, 9, 0, 9, 9, 0, 0, 9, 9, 9, 0, 9, 9]
    out = ops.contacts(frame(spark, s), K, 5.0, 2).orderBy("lo").collect()
    assert [(r["lo"], r["hi"], r["contact_id"], r["next2"]) for r in out] == [(3, 4, 0, None), (7, 9, 1, None)]


def test_longest_run_takes_the_first_on_ties(spark):
    out = ops.longest_run(frame(spark, [1, 1, 0, 1, 1, 0]), K, F.col("value") > 0).collect()[0]
    assert (out["lo"], out["hi"], out["n"]) == (0, 1, 2)


def test_nearest_ticks_are_half_even_and_unique(spark):
    df = spark.createDataFrame([(1, 10)], "clip int, n_frames bigint")
    got = sorted(r["frame"] for r in ops.nearest_ticks(df, K, 100.0, 40.0).collect())
    assert got == sorted({int(np.rint(k * 2.5)) for k in range(4)})
