"""Curve queries: embeddings are the curves, even and odd ids the two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin.functions import arrays
from tempograin.functions.numeric import r6
from tempograin.operators import curves as ops
from tempograin.operators.ordered import interval_join
from tempograin.plans.registry import query
from tempograin.plans.series import CLIPS, CYCLES, LEG, clip_frames, leg_cycles, leg_frames
from tempograin.sources.tables import Tables

POINTS = 64


def strides(t: Tables) -> DataFrame:
    """(label, side, vec_id, t, value): one row per point of every stride."""
    rows = t.embeddings.select(
        "label", F.when(F.col("vec_id") % 2 == 0, "L").otherwise("R").alias("side"), "vec_id",
        F.floor(F.col("vec_id") / 2).alias("pair"), "embedding")
    return ops.long_curves(rows, ["label", "side", "vec_id", "pair"], "embedding")


def sided(t: Tables) -> DataFrame:
    """(pair, channel, t, l, r): four channels of 16 points per session pair."""
    long = strides(t).withColumn("channel", F.floor(F.col("t") / 16).cast("int")).withColumn("t", F.col("t") % 16)
    return ops.both_sides(long, ["pair", "channel"])


def signs(t: Tables) -> DataFrame:
    return ops.mirror_signs(sided(t), ["pair"], ["channel"])


STRIDES = """strides AS (
  SELECT label, CASE WHEN vec_id % 2 = 0 THEN 'L' ELSE 'R' END AS side, vec_id, vec_id // 2 AS pair,
         CAST(i - 1 AS INTEGER) AS t, CAST(embedding[i] AS DOUBLE) AS value
  FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i))"""
SIDED = STRIDES + """,
sided AS (
  SELECT pair, t // 16 AS channel, t % 16 AS t, avg(value) FILTER (WHERE side = 'L') AS l,
         avg(value) FILTER (WHERE side = 'R') AS r FROM strides GROUP BY 1, 2, 3
  HAVING count(*) FILTER (WHERE side = 'L') > 0 AND count(*) FILTER (WHERE side = 'R') > 0)"""
SIGNS = SIDED + """,
signs AS (
  SELECT channel, count(*) AS n, CASE WHEN count(*) > 30 THEN corr(ml, mr) ELSE 0 END AS r,
         CASE WHEN round(CASE WHEN count(*) > 30 THEN corr(ml, mr) ELSE 0 END, 9) >= 0 THEN 1 ELSE -1 END AS sign
  FROM (SELECT pair, channel, avg(l) AS ml, avg(r) AS mr FROM sided GROUP BY 1, 2) GROUP BY 1)"""
DIFFS = SIGNS + """,
diffs AS (SELECT s.*, g.sign, abs(l - r) AS asym, s.r - g.sign * s.l AS d FROM sided s JOIN (SELECT channel, sign FROM signs) g USING (channel))"""


@query("a11_curve_band", f"""WITH {STRIDES}
SELECT label, t, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd
FROM strides GROUP BY 1, 2""")
def _(t):
    out = ops.curve_band(strides(t), ["label"])
    return out.select("label", "t", "n", r6(F.col("mean")).alias("mean"), r6(F.col("sd")).alias("sd"))


@query("a11_curve_quantiles", f"""WITH {STRIDES}
SELECT label, t, round(quantile_cont(value, 0.25), 6) + 0.0 AS q25, round(quantile_cont(value, 0.5), 6) + 0.0 AS q50,
       round(quantile_cont(value, 0.75), 6) + 0.0 AS q75 FROM strides GROUP BY 1, 2""")
def _(t):
    out = ops.curve_quantiles(strides(t), ["label"])
    return out.select("label", "t", *[r6(F.col(c)).alias(c) for c in ("q25", "q50", "q75")])


@query("a12_curve_order", f"""WITH {STRIDES},
q AS (SELECT label, t, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c
      FROM strides GROUP BY 1, 2)
SELECT count(*) AS n_points, count(*) FILTER (WHERE a > b + 1e-4 OR b > c + 1e-4) AS n_violations FROM q""")
def _(t):
    return ops.order_violations(ops.curve_quantiles(strides(t), ["label"]))


@query("a13_side_average", f"""WITH {SIDED}
SELECT pair, channel, t, round((l + r) / 2, 6) + 0.0 AS value FROM sided WHERE channel IN (0, 2)""")
def _(t):
    kept = sided(t).filter(F.col("channel").isin(0, 2))
    return kept.select("pair", "channel", "t", r6((F.col("l") + F.col("r")) / 2.0).alias("value"))


@query("a14_side_difference", f"""WITH {DIFFS}
SELECT pair, channel, t, round(asym, 6) + 0.0 AS asym, round(d, 6) + 0.0 AS d FROM diffs""")
def _(t):
    out = ops.side_difference(sided(t), signs(t), ["channel"])
    return out.select("pair", "channel", "t", r6(F.col("asym")).alias("asym"), r6(F.col("d")).alias("d"))


@query("a15_sign_convention", f"WITH {SIGNS} SELECT channel, n, round(r, 6) + 0.0 AS r, sign FROM signs")
def _(t):
    return signs(t).withColumn("r", r6(F.col("r")))


@query("a16_asymmetry_rms", f"""WITH {DIFFS}
SELECT pair, round(sqrt(avg(d * d)), 6) AS magnitude FROM diffs GROUP BY 1""")
def _(t):
    out = ops.side_difference(sided(t), signs(t), ["channel"])
    return out.groupBy("pair").agg(r6(F.sqrt(F.avg(F.col("d") * F.col("d")))).alias("magnitude"))


_WASSERSTEIN = """
cnt AS (SELECT {k}, v, count(*) FILTER (WHERE side = 'L') AS nl, count(*) FILTER (WHERE side = 'R') AS nr FROM vals GROUP BY {k}, v),
stp AS (SELECT {k}, v, sum(nl) OVER (PARTITION BY {k} ORDER BY v) AS cl, sum(nr) OVER (PARTITION BY {k} ORDER BY v) AS cr,
          sum(nl) OVER (PARTITION BY {k}) AS tl, sum(nr) OVER (PARTITION BY {k}) AS tr, lead(v) OVER (PARTITION BY {k} ORDER BY v) AS nx FROM cnt),
was AS (SELECT {k}, max(tl)::BIGINT AS n_l, max(tr)::BIGINT AS n_r, coalesce(sum(abs(cl::DOUBLE / nullif(tl, 0) - cr::DOUBLE / nullif(tr, 0)) * (nx - v)), 0) AS w FROM stp GROUP BY {k})"""
_EDGES = [0, 12, 25, 38, 51, 64]


@query("a17_stride_contrasts", f"""WITH {STRIDES},
vals AS (SELECT label, side, vec_id, CASE WHEN t < 12 THEN 0 WHEN t < 25 THEN 1 WHEN t < 38 THEN 2 WHEN t < 51 THEN 3 ELSE 4 END AS block,
         avg(value) AS v FROM strides GROUP BY 1, 2, 3, 4),
{_WASSERSTEIN.format(k='label, block')},
m AS (SELECT label, block, side, count(*) AS n, avg(v) AS a, quantile_cont(v, 0.5) AS md, stddev_pop(v) AS sd,
        quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM vals GROUP BY 1, 2, 3)
SELECT label, block, round(r.a - l.a, 6) + 0.0 AS d_mean, round(r.md - l.md, 6) + 0.0 AS d_median, round(r.sd - l.sd, 6) + 0.0 AS d_sd,
  round(r.iqr - l.iqr, 6) + 0.0 AS d_iqr, round(w, 6) + 0.0 AS wasserstein
FROM m l JOIN m r USING (label, block) JOIN was USING (label, block) WHERE l.side = 'L' AND r.side = 'R' AND l.n >= 3 AND r.n >= 3""")
def _(t):
    out = ops.stride_contrasts(strides(t), ["label"], "vec_id", "side", _EDGES)
    return out.select("label", "block", *[r6(F.col(c)).alias(c) for c in ("d_mean", "d_median", "d_sd", "d_iqr", "wasserstein")])


@query("a18_wasserstein", f"""WITH vals AS (
  SELECT event_type, CASE WHEN event_id % 2 = 0 THEN 'L' ELSE 'R' END AS side, value AS v FROM events),
{_WASSERSTEIN.format(k='event_type')}
SELECT event_type, n_l, n_r, round(w, 6) AS wasserstein FROM was""")
def _(t):
    rows = t.events.select("event_type", "value", F.when(F.col("event_id") % 2 == 0, "L").otherwise("R").alias("side"))
    return ops.wasserstein(rows, ["event_type"], "side", "value").withColumn("wasserstein", r6(F.col("wasserstein")))


def _as_list(expr: str, n: int) -> str:
    return f"list_transform(generate_series(0, {n - 1}), lambda i: {expr})"


_CURVE = "embedding::DOUBLE[]"


def _lerp_sql(curve: str, x: str) -> str:
    lo, hi = f"CAST(floor({x}) AS INTEGER)", f"least(CAST(floor({x}) AS INTEGER) + 1, len({curve}) - 1)"
    return f"({curve}[{lo} + 1] + ({curve}[{hi} + 1] - {curve}[{lo} + 1]) * ({x} - {lo}))"


def _rounded(c: str) -> str:
    return f"list_transform({c}, lambda v: round(v, 6) + 0.0)"


def rounded(curve) -> object:
    return F.transform(curve, lambda v: F.round(v, 6) + 0.0)


def doubles(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("curve"))


@query("c01_resample", f"""WITH e AS (SELECT vec_id, {_CURVE} AS c FROM embeddings),
o AS (SELECT vec_id, {_as_list(_lerp_sql('c', '(i * (63.0::DOUBLE / 100))'), 101)} AS curve FROM e)
SELECT vec_id, {_rounded('curve')} AS curve FROM o""")
def _(t):
    return doubles(t).select("vec_id", rounded(arrays.resample(F.col("curve"), 101)).alias("curve"))


@query("c04_slice_respread", f"""WITH e AS (SELECT vec_id, {_CURVE} AS c FROM embeddings),
o AS (SELECT vec_id, {_as_list(_lerp_sql('c', '(i * (63.0::DOUBLE * 0.36 / 100))'), 101)} AS curve FROM e)
SELECT vec_id, {_rounded('curve')} AS curve FROM o""")
def _(t):
    return doubles(t).select("vec_id", rounded(arrays.resample(F.col("curve"), 101, 0.36)).alias("curve"))


def cycle_curves(t: Tables, n: int = 101) -> DataFrame:
    """Plausible cycles of each leg as ``n``-point curves; samples stay unfilled."""
    spans = leg_cycles(t).filter("plausible").select(*LEG, "cycle_id", "lo", "hi", (F.col("hi") + 1).alias("_end"))
    inside = interval_join(leg_frames(t).select(*LEG, "frame", "value"), spans, LEG, "frame", "lo", "_end")
    return ops.normalise_cycles(inside, [*LEG, "cycle_id"], n)


CYCLE_CURVES = CYCLES + """,
pts AS (
  SELECT c.user_id, c.side, c.cycle_id, c.lo, c.hi, l.frame, l.value
  FROM cyc c JOIN legs l ON l.user_id = c.user_id AND l.side = c.side AND l.frame BETWEEN c.lo AND c.hi
  WHERE c.plausible),
sizes AS (SELECT user_id, side, cycle_id, lo, hi, count(value) AS n FROM pts GROUP BY 1, 2, 3, 4, 5),
grid AS (SELECT *, lo + (hi - lo) * i / 100.0::DOUBLE AS x FROM sizes, (SELECT unnest(generate_series(0, 100)) AS i) WHERE n >= 2),
around AS (
  SELECT g.user_id, g.side, g.cycle_id, g.i, g.x,
    max(p.frame) FILTER (WHERE p.frame <= g.x) AS f0, arg_max(p.value, p.frame) FILTER (WHERE p.frame <= g.x) AS v0,
    min(p.frame) FILTER (WHERE p.frame >= g.x) AS f1, arg_min(p.value, p.frame) FILTER (WHERE p.frame >= g.x) AS v1
  FROM grid g JOIN pts p ON p.user_id = g.user_id AND p.side = g.side AND p.cycle_id = g.cycle_id AND p.value IS NOT NULL
  GROUP BY 1, 2, 3, 4, 5),
curves AS (
  SELECT user_id, side, cycle_id, CAST(i AS INTEGER) AS t,
    CASE WHEN f0 IS NULL THEN v1 WHEN f1 IS NULL OR f1 = f0 THEN v0 ELSE v0 + (v1 - v0) * (x - f0) / (f1 - f0) END AS value FROM around)"""


@query("c02_cycle_curve", f"""WITH {CYCLE_CURVES}
SELECT s.user_id, s.side, s.cycle_id, c.curve FROM sizes s LEFT JOIN (
  SELECT user_id, side, cycle_id, list(round(value, 6) + 0.0 ORDER BY t) AS curve FROM curves GROUP BY 1, 2, 3) c USING (user_id, side, cycle_id)""")
def _(t):
    return cycle_curves(t).withColumn("curve", rounded(F.col("curve")))


@query("c03_cycle_band", f"""WITH {CYCLE_CURVES}
SELECT user_id, side, t, count(*) AS n, round(avg(value), 9) + 0.0 AS mean, round(coalesce(stddev_samp(value), 0), 6) + 0.0 AS sd
FROM curves GROUP BY 1, 2, 3""")
def _(t):
    known = cycle_curves(t).filter(F.col("curve").isNotNull())
    out = ops.curve_band(ops.long_curves(known, LEG, "curve"), LEG)
    return out.select(*LEG, "t", "n", (F.round("mean", 9) + F.lit(0.0)).alias("mean"), r6(F.col("sd")).alias("sd"))


@query("c05_curve_comparison", f"""WITH {SIDED},
st AS (SELECT pair, channel, covar_pop(l, r) / nullif(stddev_pop(l) * stddev_pop(r), 0) AS r0, avg(l) AS ml, avg(r) AS mr,
         max(l) - min(l) AS ro, max(r) - min(r) AS rt FROM sided GROUP BY 1, 2),
sg AS (SELECT channel, CASE WHEN quantile_cont(r0, 0.5) < 0 THEN -1 ELSE 1 END AS sign FROM st GROUP BY 1)
SELECT s.pair, s.channel, round(max(r0), 6) + 0.0 AS r, round(max(ml - mr), 6) + 0.0 AS "offset", round(max(ro), 6) AS range_ours,
  round(max(rt), 6) AS range_theirs, round(max(ro / nullif(rt, 0)), 6) AS amp_ratio, max(sign) AS sign,
  round(sqrt(avg(power(sign * (l - ml) - (r - mr), 2))), 6) AS rms
FROM sided s JOIN st ON st.pair = s.pair AND st.channel = s.channel JOIN sg ON sg.channel = s.channel GROUP BY 1, 2""")
def _(t):
    pairs = sided(t).select("pair", "channel", F.col("l").alias("ours"), F.col("r").alias("theirs"))
    out = ops.compare_curves(pairs, ["pair"], "channel")
    return out.select("pair", "channel", "sign", *[
        r6(F.col(c)).alias(c) for c in ("r", "offset", "range_ours", "range_theirs", "amp_ratio", "rms")])


_SIGMA = arrays.cutoff_sigma(5.0, 0.5)
_W = arrays.kernel(_SIGMA)


@query("c06_gaussian_smooth", f"""WITH {CLIPS},
ker AS (SELECT unnest(generate_series(-{len(_W) // 2}, {len(_W) // 2})) AS k, unnest([{', '.join(repr(w) for w in _W)}]::DOUBLE[]) AS w),
n AS (SELECT user_id, max(frame) AS last FROM clips GROUP BY 1)
SELECT a.user_id, a.frame, round(sum(ker.w * b.value), 6) AS smooth
FROM clips a JOIN n ON n.user_id = a.user_id CROSS JOIN ker
JOIN clips b ON b.user_id = a.user_id AND b.frame = greatest(0, least(a.frame + ker.k, n.last)) GROUP BY 1, 2""")
def _(t):
    out = ops.smooth_series(clip_frames(t).select("user_id", "frame", "value"), ["user_id"], "value", _SIGMA)
    return out.select("user_id", "frame", r6(F.col("smooth")).alias("smooth"))


def _pchip_steps(source: str, values: str, n: int) -> str:
    """CTEs that rebuild list column ``values`` of ``source`` at n points, as ``rebuilt``."""
    def end(a, b):
        d = f"((3.0 * {a} - {b}) / 2.0)"
        return (f"CASE WHEN sign({d}) <> sign({a}) THEN 0.0 WHEN sign({a}) <> sign({b}) AND abs({d}) > 3.0 * abs({a}) "
                f"THEN 3.0 * {a} ELSE {d} END")
    x = f"((len(y) - 1) * i / {float(n - 1)}::DOUBLE)"
    k = f"least(CAST(floor({x}) AS INTEGER), len(y) - 2)"
    s = f"({x} - {k})"
    return f"""
pc0 AS (SELECT *, {values} AS y FROM {source}),
pc1 AS (SELECT *, list_transform(generate_series(1, len(y) - 1), lambda i: y[i + 1] - y[i]) AS m FROM pc0),
pc2 AS (SELECT *, list_transform(generate_series(1, len(y)), lambda i: CASE WHEN i = 1 THEN {end('m[1]', 'm[2]')}
   WHEN i = len(y) THEN {end('m[len(y) - 1]', 'm[len(y) - 2]')}
   WHEN m[i - 1] * m[i] <= 0 THEN 0.0 ELSE 2.0 * m[i - 1] * m[i] / (m[i - 1] + m[i]) END::DOUBLE) AS sl FROM pc1),
pc3 AS (SELECT *, list_transform(generate_series(0, {n - 1}), lambda i:
   y[{k} + 1] * (1 + 2 * {s}) * (1 - {s}) * (1 - {s}) + sl[{k} + 1] * {s} * (1 - {s}) * (1 - {s})
   + y[{k} + 2] * {s} * {s} * (3 - 2 * {s}) + sl[{k} + 2] * {s} * {s} * ({s} - 1)) AS rebuilt FROM pc2)"""


@query("c07_monotone_rebuild", f"""WITH e AS (SELECT vec_id, {_CURVE} AS c FROM embeddings),
d AS (SELECT vec_id, {_as_list(_lerp_sql('c', '(i * (63.0::DOUBLE / 15))'), 16)} AS v FROM e), {_pchip_steps('d', 'v', 64)}
SELECT vec_id, {_rounded('rebuilt')} AS curve FROM pc3""")
def _(t):
    few = doubles(t).withColumn("y", arrays.resample(F.col("curve"), 16)).withColumn("d", arrays.pchip_slopes(F.col("y")))
    return few.select("vec_id", rounded(arrays.pchip(F.col("y"), F.col("d"), 64)).alias("curve"))


_DSIG = arrays.cutoff_sigma(16 / 0.25, 10.0)
_DW = arrays.kernel(_DSIG)


def _u(tag: str) -> str:
    return f"((CAST('0x' || substr(md5('7|' || vec_id || '|' || (i - 1) || '|{tag}'), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE)"


@query("c08_degrade", f"""WITH e AS (SELECT vec_id, {_CURVE} AS c FROM embeddings),
d AS (SELECT vec_id, {_as_list(_lerp_sql('c', '(i * (63.0::DOUBLE / 15))'), 16)} AS v FROM e),
nz AS (SELECT vec_id, list_transform(generate_series(1, 16), lambda i: v[i] + 0.02::DOUBLE * sqrt(-2.0 * ln({_u('a')})) * cos(2.0 * pi() * {_u('b')})) AS v FROM d),
sm AS (SELECT vec_id, list_transform(generate_series(1, 16), lambda i: """ + " + ".join(
    f"{w!r}::DOUBLE * v[greatest(1, least(i + {k - len(_DW) // 2}, 16))]" for k, w in enumerate(_DW)) + f""") AS v FROM nz),
{_pchip_steps('sm', 'v', 64)}
SELECT vec_id, {_rounded('rebuilt')} AS curve FROM pc3""")
def _(t):
    out = ops.degrade(doubles(t), "vec_id", "curve", 16, 0.02, 0.25, 7, POINTS)
    return out.select("vec_id", rounded(F.col("degraded")).alias("curve"))


@query("c09_bank_perturbation", f"""WITH pairs AS (
  SELECT a.vec_id // 2 AS pair, a.embedding::DOUBLE[] AS l, b.embedding::DOUBLE[] AS r
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
bank AS (SELECT pair AS clip, list_transform(l, lambda v: v * 0.1) AS near, list_transform(r, lambda v: v * 0.1) AS far,
         row_number() OVER (ORDER BY pair) - 1 AS i, count(*) OVER () AS nb FROM pairs),
drawn AS (SELECT *, CAST('0x' || substr(md5('5|' || pair || '|clip'), 1, 8) AS BIGINT) % (SELECT count(*) FROM bank) AS i,
         CAST('0x' || substr(md5('5|' || pair || '|far'), 1, 8) AS BIGINT) % 2 = 1 AS rf FROM pairs),
j AS (SELECT pair, l, r, CASE WHEN rf THEN near ELSE far END AS el, CASE WHEN rf THEN far ELSE near END AS er FROM drawn JOIN bank USING (i)),
m AS (SELECT *, list_transform(generate_series(1, 64), lambda k: l[k] + 1.5::DOUBLE * el[k]) AS lm,
        list_transform(generate_series(1, 64), lambda k: r[k] + 1.5::DOUBLE * er[k]) AS rm FROM j)
SELECT pair, {_rounded('lm')} AS l_moved, {_rounded('rm')} AS r_moved,
  round((list_sum(list_transform(generate_series(1, 64), lambda k: abs(lm[k] - l[k]))) / 64 +
         list_sum(list_transform(generate_series(1, 64), lambda k: abs(rm[k] - r[k]))) / 64) / 2, 6) AS realised FROM m""")
def _(t):
    c = doubles(t).withColumn("pair", F.floor(F.col("vec_id") / 2))
    even = c.filter("vec_id % 2 = 0").select("pair", F.col("curve").alias("l"))
    pairs = even.join(c.filter("vec_id % 2 = 1").select("pair", F.col("curve").alias("r")), "pair")

    def tenth(name):
        return F.transform(name, lambda v: v * 0.1)
    bank = pairs.select(F.col("pair").alias("clip"), tenth("l").alias("near"), tenth("r").alias("far"))
    out = ops.perturb_from_bank(pairs, bank, "pair", 5, 1.5)
    return out.select("pair", rounded(F.col("l_moved")).alias("l_moved"), rounded(F.col("r_moved")).alias("r_moved"),
                      r6(F.col("realised")).alias("realised"))


@query("c10_injected_difference", f"""WITH {SIGNS},
pick AS (SELECT *, CAST('0x' || substr(md5(pair || '|11'), 1, 8) AS BIGINT) % 2 = 1 AS right_side,
  0.75::DOUBLE * exp(-0.5::DOUBLE * power((t / 15.0::DOUBLE - 0.4::DOUBLE) / 0.12::DOUBLE, 2)) AS a FROM sided)
SELECT pair, channel, t, round((p.r + CASE WHEN right_side THEN a ELSE 0 END) - sign * (p.l + CASE WHEN right_side THEN 0 ELSE a END), 6) + 0.0 AS d
FROM pick p JOIN (SELECT channel, sign FROM signs) USING (channel)""")
def _(t):
    chosen = ops.random_side(F.col("pair"), 11)
    moved = ops.inject(sided(t), chosen, 0.75, ops.bump(F.col("t"), 16))
    out = ops.side_difference(moved, signs(t), ["channel"])
    return out.select("pair", "channel", "t", r6(F.col("d")).alias("d"))


@query("c11_random_side", """SELECT o_orderkey, o_custkey,
  CASE WHEN CAST('0x' || substr(md5(o_custkey::VARCHAR || '|23'), 1, 8) AS BIGINT) % 2 = 1 THEN 'R' ELSE 'L' END AS side FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", "o_custkey", ops.random_side(F.col("o_custkey"), 23).alias("side"))


@query("c12_channel_means", f"""WITH {STRIDES}
SELECT vec_id, t // 16 AS channel, round(avg(value), 6) + 0.0 AS value FROM strides GROUP BY 1, 2""")
def _(t):
    return (strides(t).groupBy("vec_id", F.floor(F.col("t") / 16).cast("int").alias("channel"))
            .agg(r6(F.avg("value")).alias("value")))


@query("c13_feature_vector", f"""WITH {STRIDES},
m AS (SELECT vec_id, t // 16 AS channel, round(avg(value), 6) + 0.0 AS value FROM strides GROUP BY 1, 2)
SELECT vec_id, list(value ORDER BY channel) AS features FROM m GROUP BY 1""")
def _(t):
    long = (strides(t).groupBy("vec_id", F.floor(F.col("t") / 16).alias("channel")).agg(r6(F.avg("value")).alias("value")))
    return ops.wide_vector(long, ["vec_id"])


@query("j06_realign", """SELECT e.vec_id, e.label, d.lang, round(e.embedding[1]::DOUBLE, 6) + 0.0 AS first_point
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id""")
def _(t):
    return (t.embeddings.join(t.documents, F.col("doc_id") == F.col("vec_id"))
            .select("vec_id", "label", "lang", r6(F.element_at("embedding", 1)).alias("first_point")))


@query("j12_near_far_pairs", """WITH r AS (SELECT vec_id // 2 AS clip, CASE WHEN vec_id % 2 = 0 THEN 'near' ELSE 'far' END AS limb,
    CASE WHEN vec_id % 7 <> 0 THEN embedding[1]::DOUBLE END AS v FROM embeddings)
SELECT clip, round(max(v) FILTER (WHERE limb = 'near'), 6) + 0.0 AS near, round(max(v) FILTER (WHERE limb = 'far'), 6) + 0.0 AS far
FROM r GROUP BY 1 HAVING count(DISTINCT CASE WHEN v IS NOT NULL THEN limb END) = 2""")
def _(t):
    """Near and far value of each clip; a clip with a missing side is incomplete."""
    rows = t.embeddings.select(
        F.floor(F.col("vec_id") / 2).alias("clip"), F.when(F.col("vec_id") % 2 == 0, "near").otherwise("far").alias("limb"),
        F.when(F.col("vec_id") % 7 != 0, r6(F.element_at("embedding", 1))).alias("v"))
    return rows.groupBy("clip").pivot("limb", ["near", "far"]).agg(F.max("v")).dropna()


@query("j16_block_concat", f"""WITH {STRIDES},
a AS (SELECT vec_id, 'ch' || (t // 16) AS feature, round(avg(value), 6) + 0.0 AS value FROM strides GROUP BY 1, 2),
b AS (SELECT vec_id, CASE WHEN t // 32 = 0 THEN 'ch0' ELSE 'half' END AS feature,
   round(avg(value) FILTER (WHERE t // 32 = 1 OR t < 16), 6) + 0.0 AS value FROM strides GROUP BY 1, 2)
SELECT DISTINCT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def _(t):
    s = strides(t)
    a = s.groupBy("vec_id", F.concat(F.lit("ch"), F.floor(F.col("t") / 16).cast("string")).alias("feature")).agg(
        r6(F.avg("value")).alias("value"))
    b = s.groupBy("vec_id", F.when(F.col("t") < 32, "ch0").otherwise("half").alias("feature")).agg(
        r6(F.avg(F.when((F.col("t") >= 32) | (F.col("t") < 16), F.col("value")))).alias("value"))
    return a.unionByName(b).dropDuplicates(["vec_id", "feature", "value"])
