"""Containment of names against comparing every pair."""

import random

import numpy as np
import pytest

from tempograin.operators import joins


def test_contained_names_equal_all_pairs(spark):
    rng = random.Random(6)

    def name():
        return "".join(rng.choice("abé🙂") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 9])))
    left, right = [name() for _ in range(150)] + [None], [name() for _ in range(60)] + [None, "zz", "a.b", "(a"]
    left += ["zzz", "xa.bx", "x(a", "q"]
    want = {}
    for a in filter(None, left):
        hits = [b for b in filter(None, right) if a in b or b in a]
        if hits:
            want[a] = min(hits, key=lambda b: b.encode())
    got = joins.contained_name(spark.createDataFrame([(v,) for v in left], "l string"), spark.createDataFrame([(v,) for v in right], "r string"), "l", "r")
    assert {r["l"]: r["r"] for r in got.collect()} == want and len(want) > 50 and "q" not in want


def test_very_long_names(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    left = spark.createDataFrame([(long,), ("nothing",)], "l string")
    right = spark.createDataFrame([(long[500:90_000],), (long[70_000:70_040],), ("zzz",), ("x" + long + "y",)], "r string")
    rows = joins.contained_name(left, right, "l", "r").collect()
    assert [(len(r["l"]), r["r"]) for r in rows] == [(100_000, min(long[500:90_000], long[70_000:70_040], "x" + long + "y"))]


@pytest.mark.parametrize("few", [0, 6, 10 ** 9])
def test_nearest_within_in_blocks_is_the_brute_force(spark, monkeypatch, few):
    # All vectors share a few wide cells: in blocks of 8, as rows, and both.
    monkeypatch.setattr(joins, "BLOCK_ROWS", 8)
    monkeypatch.setattr(joins, "FEW_PAIRS", few)
    rng = np.random.default_rng(4)
    a, b = rng.integers(-2, 3, (60, 3)) / 4.0, rng.integers(-2, 3, (50, 3)) / 4.0
    a[7, 1] = np.nan
    made = [spark.createDataFrame([(i + n, [float(x) for x in v]) for i, v in enumerate(vs)], f"{k} bigint, v array<double>")
            for vs, k, n in ((a, "p", 0), (b, "q", 1000))]
    got = {r["p"]: (r["q"], r["d"]) for r in joins.match_within(
        *made, "p", "q", "v", 0.3, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]).withColumnRenamed("distance", "d").collect()}
    want = {}
    for i, v in enumerate(a):
        d, k = min((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in enumerate(b))
        if i != 7 and d <= 0.3:
            want[i] = (k + 1000, d)
    assert got == want and len(want) > 20
