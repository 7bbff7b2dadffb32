"""The chunk-safe primitives against brute force, with one group holding most rows."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempograin.operators import ordered as od
from tempograin.operators.ordered import Index, Known, Neighbour, RunningMax, RunningMin, RunningSum


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    keys = np.r_[np.zeros(400), rng.integers(1, 30, 200)].astype(int)
    df = pd.DataFrame({"k": keys, "t": rng.permutation(len(keys)), "v": np.round(rng.normal(size=len(keys)), 2)})
    df.loc[rng.random(len(df)) < 0.3, "v"] = None
    return df


def expected(pdf):
    p = pdf.sort_values(["k", "t"]).copy()
    g = p.groupby("k")["v"]
    p["i"] = p.groupby("k").cumcount()
    p["s"] = g.transform(lambda v: v.fillna(0).cumsum())
    p["lo"] = g.transform(lambda v: v.expanding().min())
    p["hi"] = g.transform(lambda v: v[::-1].expanding().max()[::-1])
    p["prev"] = g.transform("ffill")
    p["next"] = g.transform("bfill")
    p["lag"], p["lead"] = g.shift(1), g.shift(-1)
    return p.reset_index(drop=True)


@pytest.mark.parametrize("rows", [0, 25])
def test_all_specs(spark, chunked, skewed, rows):
    if rows:
        chunked(rows)
    df = spark.createDataFrame(skewed.astype({"v": "float64"})).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    v = F.col("v")
    out = od.cut(df, ["k"], ["t"]).add(
        i=Index(), s=RunningSum(v), lo=RunningMin(v), hi=RunningMax(v, backward=True), prev=Known(v),
        next=Known(v, backward=True), lag=Neighbour(v), lead=Neighbour(v, backward=True))
    assert out.chunked == bool(rows)
    got = out.rows().toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    want = expected(skewed)
    for c in ("i", "lo", "hi", "prev", "next", "lag", "lead"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), err_msg=c)
    np.testing.assert_allclose(got["s"].fillna(0).astype(float), want["s"], atol=1e-9)


@pytest.mark.parametrize("rows", [0, 25])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles(spark, chunked, skewed, rows, keys):
    if rows:
        chunked(rows)
    df = spark.createDataFrame(skewed).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    got = od.quantiles(df, keys, "v", {"a": 0.05, "b": 0.5, "c": 0.95}).toPandas()
    for _, row in got.iterrows():
        part = skewed if not keys else skewed[skewed.k == row["k"]]
        vals = part.v.dropna()
        want = np.percentile(vals, [5, 50, 95]) if len(vals) else [np.nan] * 3
        np.testing.assert_allclose([row.a, row.b, row.c], want)


@pytest.mark.parametrize("rows", [0, 25])
def test_average_ranks_and_runs(spark, chunked, skewed, rows):
    if rows:
        chunked(rows)
    pdf = skewed.fillna({"v": 0.0}).sort_values(["k", "t"])
    pdf["frame"] = pdf.groupby("k").cumcount()
    df = spark.createDataFrame(pdf)
    got = od.average_ranks(df, ["k"], "v", "r").toPandas().sort_values(["k", "frame"])
    np.testing.assert_allclose(got.r, pdf.groupby("k").v.rank())
    found = od.runs(od.cut(df, ["k"], ["frame"]), F.col("v") > 0, "frame").toPandas()
    want = []
    for k, g in pdf.groupby("k"):
        flags = (g.v > 0).to_numpy()
        start = None
        for i, f in enumerate([*flags, False]):
            if f and start is None:
                start = i
            elif not f and start is not None:
                want.append((k, start, i - 1, i - start))
                start = None
    assert sorted(map(tuple, found[["k", "lo", "hi", "n"]].to_numpy().tolist())) == sorted(want)


def test_halo_answers_lag_across_blocks(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("frame"), (F.col("id") * 3).alias("v"))
    halo = od.with_halo(df, "frame", 7, block=50)
    w = od.block_window(["k"], "frame")
    out = halo.select("frame", "_halo", F.lag("v", 7).over(w).alias("a"), F.lead("v", 7).over(w).alias("b")).filter("not _halo").toPandas().sort_values("frame")
    assert len(out) == 1000
    want = pd.Series(np.arange(1000) * 3)
    pd.testing.assert_series_equal(out.a.reset_index(drop=True), want.shift(7), check_names=False)
    pd.testing.assert_series_equal(out.b.reset_index(drop=True), want.shift(-7), check_names=False)


def test_interval_join_crosses_cells(spark):
    rng = np.random.default_rng(1)
    spans = pd.DataFrame({"k": 1, "lo": rng.integers(0, 900, 60), "name": range(60)})
    spans["hi"] = spans.lo + rng.integers(0, 300, 60)
    points = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("frame"))
    out = od.interval_join(points, spark.createDataFrame(spans), ["k"], "frame", "lo", "hi", width=64).toPandas()
    want = {(f, r.name_) for r in spans.rename(columns={"name": "name_"}).itertuples() for f in range(r.lo, min(r.hi, 1000))}
    assert len(out) == len(want) and set(zip(out.frame, out.name)) == want


def test_chunk_borders_do_not_change_ties(spark, chunked):
    """Equal order values of different groups share a border but not a group."""
    chunked(10)
    df = spark.range(300).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).alias("t"))
    got = od.cut(df, ["k"], ["t"]).add(i=Index()).rows().toPandas()
    assert (got.i == got.t).all()

# ------------------------------------------------- the two paths against each other

def odd_rows(spark):
    """Null and NaN keys, null, NaN, tied and text order values."""
    rng = np.random.default_rng(8)
    rows = [(None if i % 5 == 0 else float("nan") if i % 5 == 1 else float(i % 3),
             None if i % 11 == 0 else float("nan") if i % 13 == 0 else float(rng.integers(0, 6)),
             None if i % 17 == 0 else str(int(rng.integers(0, 200))), i, None if i % 4 == 0 else float(rng.integers(0, 9)))
            for i in range(400)]
    return spark.createDataFrame(rows, "k double, t double, s string, id long, v double")


def same_rows(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("keys", [[], ["k"], ["k", "s"]])
@pytest.mark.parametrize("order", [["id"], ["t", "id"], ["s", "id"], ["s", "t", "id"]])
def test_paths_agree_on_odd_values(spark, chunked, keys, order):
    df, v = odd_rows(spark), F.col("v")
    def run():
        out = od.cut(df, keys, order).add(
            i=Index(), s_=RunningSum(v), lo=RunningMin(v), hi=RunningMax(v, backward=True), prev=Known(v),
            next=Known(v, backward=True), lag=Neighbour(v), lead=Neighbour(v, backward=True))
        return out.chunked, out.rows()
    plain, want = run()
    chunked(30)
    cut_up, got = run()
    assert (plain, cut_up) == (False, True)
    assert got.count() == 400 and same_rows(got, want)


@pytest.mark.parametrize("keys", [["k"], ["s"]])
def test_quantiles_ranks_and_runs_agree_on_odd_values(spark, chunked, keys):
    df = odd_rows(spark).withColumn("t", F.nanvl("t", F.lit(None).cast("double")))
    def run():
        ordered = od.cut(df, keys, ["id"]).add(i=Index())
        return [od.quantiles(df, keys, "v", {"a": 0.1, "b": 0.5}), od.average_ranks(df, keys, "v", "r"),
                od.runs(ordered, F.col("v") > 2, "i")]
    want = [x.collect() for x in run()]
    chunked(30)
    for got, w in zip(run(), want):
        assert sorted(map(repr, got.collect())) == sorted(map(repr, w))
    assert any(r["k" if keys == ["k"] else "s"] is None and r["b"] is not None for r in want[0])


def test_ties_on_the_first_column_are_split(spark, chunked):
    chunked(100)
    df = spark.range(4000).select(F.lit(1).alias("a"), F.col("id").alias("b"))
    out = od.cut(df, [], ["a", "b"]).add(i=Index())
    assert out.df.select(od.CHUNK).distinct().count() >= 30
    assert out.rows().filter("i != b").count() == 0


def test_halo_reaches_over_a_block(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("frame"))
    halo = od.with_halo(df, "frame", 250, block=100)
    w = od.block_window(["k"], "frame")
    rows = halo.select("frame", "_halo", F.lead("frame", 250).over(w).alias("x")).filter("not _halo")
    assert rows.count() == 1000 and rows.filter("x = frame + 250").count() == 750


def test_exact_signed_rank_p(spark):
    from tempograin.operators import statistics as st
    rng = np.random.default_rng(2)
    rows = [(k if k else None, float(d)) for k, n in enumerate((6, 9, 12)) for d in rng.normal(0.4, 1, n)]
    rows += [(7, 1.0), (7, 1.0), (7, -2.0), (8, 0.0), (8, 0.0)]
    got = {r.k: r for r in st.wilcoxon(spark.createDataFrame(rows, "k long, d double"), ["k"], "d").collect()}
    for key in (None, 1, 2):
        d = np.array([x for k, x in rows if k == key])
        n, order = len(d), np.argsort(np.argsort(np.abs(d))) + 1
        w = order[d > 0].sum()
        sums = [sum(j + 1 for j in range(n) if m >> j & 1) for m in range(1 << n)]
        p = min(1.0, 2 * min(np.mean(np.array(sums) <= w), np.mean(np.array(sums) >= w)))
        assert (got[key].n, got[key].w_plus) == (n, w) and got[key].p == pytest.approx(p)
    assert got[7].n == 3 and 0 < got[7].p <= 1 and (got[8].n, got[8].p) == (0, 1.0)


@pytest.mark.parametrize("rows", [None, 500])
def test_quantiles_of_groups_equal_duckdb_to_the_last_bit(spark, chunked, rows):
    """A band border made of two quantiles can be a value itself; one bit puts that value on the other side."""
    if rows:
        chunked(rows)
    rng = np.random.default_rng(1)
    values = [(g, float(v)) for g in range(200) for v in np.round(rng.exponential(50, 5 + g % 50), 2) * (-1) ** (g % 2)]
    df = spark.createDataFrame([*values, (1, None), (900, None)], "g bigint, v double")
    made = pd.DataFrame(values, columns=["g", "v"])  # noqa: F841 (DuckDB reads it by name)
    want = {g: (a, b) for g, a, b in duckdb.sql("SELECT g, quantile_cont(v, 0.05), quantile_cont(v, 0.95) FROM made GROUP BY g").fetchall()}
    got = {r["g"]: (r["a"], r["b"]) for r in od.quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.95}).collect()}
    assert got.pop(900) == (None, None) and got == want


@pytest.mark.parametrize("bound", [3, 100_000])
def test_many_small_groups_are_not_cut(spark, monkeypatch, bound):
    """Beyond the small inputs, groups of few values take one window; larger ones are cut as before."""
    cuts = []
    cut = od.cut
    monkeypatch.setattr(od.session, "surely_small", lambda df: False)
    monkeypatch.setattr(od, "BOUNDED_GROUP", bound)
    monkeypatch.setattr(od, "cut", lambda *a: cuts.append(a) or cut(*a))
    values = [(g % 7 or None, None if g % 5 == 0 else float(g % 11)) for g in range(300)] + [(900, None)]
    df = spark.createDataFrame(values, "g bigint, v double")
    got = {r["g"]: (r["a"], r["b"]) for r in od.quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.95}).collect()}
    for g, pair in got.items():
        known = [v for k, v in values if k == g and v is not None]
        assert pair == (None, None) if not known else np.allclose(pair, np.quantile(known, [0.05, 0.95]))
    assert len(got) == 8 and len(cuts) == (bound == 3)
