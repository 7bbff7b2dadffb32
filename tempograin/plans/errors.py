"""Error-table queries: line items are clips seen by cameras, suppliers the subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin.functions.numeric import r6
from tempograin.operators import errors as ops
from tempograin.operators import geometry as geo
from tempograin.operators import joins
from tempograin.operators.ordered import quantiles
from tempograin.operators.series import longest_run, number_frames
from tempograin.operators.windows import apply_windows, triangle
from tempograin.plans.geometry import CLIP, MODEL, SKEL, skeletons
from tempograin.plans.registry import query
from tempograin.plans.series import CLIPS, clip_frames
from tempograin.sources.tables import Tables

ROW_COLUMNS = {
    "subject": "l_suppkey", "clip": "l_orderkey", "camera": "l_linenumber", "trial": "l_orderkey % 7",
    "joint": "CASE l_returnflag WHEN 'A' THEN 'hip' WHEN 'N' THEN 'knee' ELSE 'ankle' END",
    "limb": "CASE WHEN l_linestatus = 'F' THEN 'near' ELSE 'far' END",
    "est": "l_quantity + l_discount * 100", "ref": "l_quantity + l_tax * 100",
    "mae": "abs(l_discount * 100 - l_tax * 100)", "price": "l_extendedprice / l_quantity"}
ROWS = "rws AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in ROW_COLUMNS.items()) + " FROM lineitem)"


def error_rows(t: Tables) -> DataFrame:
    return t.lineitem.select(*[F.expr(e).alias(n) for n, e in ROW_COLUMNS.items()])


def rounded(df: DataFrame, plain: list[str], values: list[str], places: int = 6) -> DataFrame:
    return df.select(*plain, *[(F.round(F.col(c).cast("double"), places) + 0.0).alias(c) for c in values])


def sq(e: str, places: int = 6) -> str:
    return f"round({e}, {places}) + 0.0"


@query("a19_error_statistics", f"""WITH {ROWS},
s AS (SELECT subject, joint, limb, count(*) AS n, avg(abs(est - ref)) AS mae, avg(est - ref) AS bias, stddev_samp(est - ref) AS sd,
  CASE WHEN stddev_pop(est) >= 1e-12 AND stddev_pop(ref) >= 1e-12 THEN covar_pop(est, ref) / (stddev_pop(est) * stddev_pop(ref)) END AS r FROM rws GROUP BY 1, 2, 3)
SELECT subject, joint, limb, n, CASE WHEN n >= 5 THEN {sq('mae')} END AS mae, CASE WHEN n >= 5 THEN {sq('bias')} END AS bias,
  CASE WHEN n >= 5 THEN {sq('sd')} END AS sd, CASE WHEN n >= 5 THEN {sq('r')} END AS r FROM s""")
def _(t):
    return rounded(ops.error_stats(error_rows(t), ["subject", "joint", "limb"], "est", "ref"), ["subject", "joint", "limb", "n"], ["mae", "bias", "sd", "r"])


@query("a20_error_decomposition", f"""WITH {ROWS},
p AS (SELECT subject, camera, count(*) AS k, avg(est - ref) AS m, stddev_pop(est - ref) AS s FROM rws GROUP BY 1, 2),
o AS (SELECT subject, count(*) AS n_strides, stddev_pop(m) AS sys, avg(CASE WHEN k > 1 THEN s END) AS wi FROM p GROUP BY 1)
SELECT subject, n_strides, {sq('sys')} AS systematic_sd, {sq('wi')} AS within_sd, {sq('sqrt(sys * sys + wi * wi / greatest(n_strides, 1))')} AS effective_sigma FROM o""")
def _(t):
    out = ops.decompose_error(error_rows(t), ["subject"], "camera", F.col("est") - F.col("ref"))
    return rounded(out, ["subject", "n_strides"], ["systematic_sd", "within_sd", "effective_sigma"])


@query("a21_subject_first", f"""WITH {ROWS},
p AS (SELECT joint, subject, avg(mae) AS m, sum(mae) AS s, count(*) AS n FROM rws GROUP BY 1, 2)
SELECT joint, count(*) AS n_subjects, {sq('avg(m)')} AS subject_mean, {sq('stddev_samp(m)')} AS sd_across, {sq('sum(s) / sum(n)')} AS pooled_mean, sum(n)::BIGINT AS n_rows FROM p GROUP BY 1""")
def _(t):
    return rounded(ops.subject_first(error_rows(t), ["joint"], "subject", "mae"), ["joint", "n_subjects", "n_rows"], ["subject_mean", "sd_across", "pooled_mean"])


@query("a22_near_far_split", f"""WITH {ROWS},
w AS (SELECT subject, trial, limb, avg(mae) FILTER (WHERE joint = 'hip') AS h, avg(mae) FILTER (WHERE joint = 'knee') AS k FROM rws GROUP BY 1, 2, 3),
p AS (SELECT limb, subject, avg((h + k) / 2) AS m, count(*) AS n FROM w WHERE h IS NOT NULL AND k IS NOT NULL GROUP BY 1, 2)
SELECT limb, count(*) AS n_subjects, {sq('avg(m)')} AS subject_mean, sum(n)::BIGINT AS n_rows FROM p GROUP BY 1""")
def _(t):
    rows = ops.complete_rows(error_rows(t), ["subject", "trial", "limb"], "joint", ["hip", "knee"], "mae")
    return rounded(ops.subject_first(rows, ["limb"], "subject", "mae"), ["limb", "n_subjects", "n_rows"], ["subject_mean"])


@query("a24_variation", f"""WITH {ROWS}
SELECT subject, joint, CASE WHEN count(price) >= 2 AND min(price) > 0 THEN {sq('100.0 * stddev_samp(price) / avg(price)')} END AS cv_percent,
  CASE WHEN count(*) >= 2 AND abs(avg(est - ref)) >= 1e-12 THEN {sq('abs(stddev_samp(est - ref) / avg(est - ref))', 4)} END AS cv_abs FROM rws GROUP BY 1, 2""")
def _(t):
    d = F.col("est") - F.col("ref")
    return error_rows(t).groupBy("subject", "joint").agg(
        r6(ops.cv_percent(F.col("price"))).alias("cv_percent"), (F.round(ops.cv_absolute(d), 4) + 0.0).alias("cv_abs"))


STABILITY = ROWS + """,
med AS (SELECT subject, trial, quantile_cont(price, 0.5) AS m, CASE WHEN count(*) >= 2 AND min(price) > 0 THEN 100.0 * stddev_samp(price) / avg(price) END AS cams FROM rws GROUP BY 1, 2),
sub AS (SELECT subject, CASE WHEN count(*) >= 2 AND min(m) > 0 THEN 100.0 * stddev_samp(m) / avg(m) END AS tr FROM med GROUP BY 1)"""


@query("a25_stability", f"WITH {STABILITY} SELECT (SELECT {sq('avg(tr)')} FROM sub) AS cv_across_trials, (SELECT count(tr) FROM sub) AS n_subjects, (SELECT {sq('avg(cams)')} FROM med) AS cv_across_cameras")
def _(t):
    return rounded(ops.stability(error_rows(t), "subject", "trial", "price"), ["n_subjects"], ["cv_across_trials", "cv_across_cameras"])


@query("a26_kill_test", f"""WITH {STABILITY}, x AS (SELECT (SELECT avg(tr) FROM sub) AS a, (SELECT avg(cams) FROM med) AS w)
SELECT {sq('a')} AS across_trials, {sq('w')} AS within_clip, CASE WHEN a IS NULL OR w IS NULL THEN false ELSE a >= w END AS scan_adds_nothing FROM x""")
def _(t):
    out = ops.stability(error_rows(t), "subject", "trial", "price")
    a, w = F.col("cv_across_trials"), F.col("cv_across_cameras")
    return out.select(r6(a).alias("across_trials"), r6(w).alias("within_clip"), F.coalesce(a >= w, F.lit(False)).alias("scan_adds_nothing"))


@query("a27_shape_bias", f"""WITH {ROWS}, p AS (SELECT joint, subject, avg(100.0 * (est - ref) / ref) AS m, count(*) AS n FROM rws WHERE ref <> 0 GROUP BY 1, 2)
SELECT joint, count(*) AS n_subjects, {sq('avg(m)')} AS bias_pct, {sq('stddev_samp(m)')} AS sd_across FROM p GROUP BY 1""")
def _(t):
    rows = error_rows(t).filter("ref <> 0").withColumn("b", 100.0 * (F.col("est") - F.col("ref")) / F.col("ref"))
    out = ops.subject_first(rows, ["joint"], "subject", "b").withColumnRenamed("subject_mean", "bias_pct")
    return rounded(out, ["joint", "n_subjects"], ["bias_pct", "sd_across"])


@query("a28_symmetry", f"WITH {SKEL}, {MODEL} " + " UNION ALL ".join(
    f"SELECT l.clip, '{s}' AS segment, {sq('100.0 * abs(l.length - r.length) / ((l.length + r.length) / 2)')} AS asymmetry, 100.0 * abs(l.length - r.length) / ((l.length + r.length) / 2) > 5 AS flagged FROM model l JOIN model r USING (clip) WHERE l.segment = '{s}_l' AND r.segment = '{s}_r'"
    for s in ("thigh", "shank")))
def _(t):
    model = geo.body_model(geo.lengths(skeletons(t)), CLIP)
    part, side = F.split("segment", "_")[0], F.split("segment", "_")[1]
    limbs = model.filter(F.col("segment").rlike("^(thigh|shank)_")).select("clip", part.alias("segment"), side.alias("_s"), "length")
    wide = limbs.groupBy("clip", "segment").pivot("_s", ["l", "r"]).agg(F.max("length"))
    asym = ops.asymmetry_percent(F.col("l"), F.col("r"))
    return wide.select("clip", "segment", r6(asym).alias("asymmetry"), (asym > 5).alias("flagged"))


@query("a29_pivot_table", f"""WITH {ROWS} SELECT joint, {sq("avg(mae) FILTER (WHERE limb = 'near')", 2)} AS near, {sq("avg(mae) FILTER (WHERE limb = 'far')", 2)} AS far FROM rws GROUP BY 1""")
def _(t):
    out = error_rows(t).groupBy("joint").pivot("limb", ["near", "far"]).agg(F.avg("mae"))
    return rounded(out, ["joint"], ["near", "far"], 2)


@query("a30_cross_subject_summary", f"""WITH p AS (SELECT event_type AS motion, user_id, count(*) AS k, quantile_cont(value, 0.5) AS m FROM events GROUP BY 1, 2)
SELECT motion, count(*) AS n_subjects, min(k) AS fewest, quantile_cont(k, 0.5) AS middle, max(k) AS most, {sq('quantile_cont(m, 0.5)')} AS median_of_medians FROM p GROUP BY 1""")
def _(t):
    keys = ["motion", "user_id"]
    rows = t.events.select(F.col("event_type").alias("motion"), "user_id", "value")
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).join(quantiles(rows, keys, "value", {"m": 0.5}), keys)
    basic = per.groupBy("motion").agg(F.count(F.lit(1)).alias("n_subjects"), F.min("k").alias("fewest"), F.max("k").alias("most"))
    q = quantiles(per, ["motion"], "k", {"middle": 0.5}).join(quantiles(per, ["motion"], "m", {"median_of_medians": 0.5}), "motion")
    return basic.join(q, "motion").select("motion", "n_subjects", "fewest", "middle", "most", r6(F.col("median_of_medians")).alias("median_of_medians"))


@query("a31_quartile_bins", f"""WITH v AS (SELECT (o_orderkey * 37 % 1000) / 1000.0::DOUBLE AS r, o_totalprice AS e FROM orders),
q AS (SELECT quantile_cont(r, 0.25) AS a, quantile_cont(r, 0.5) AS b, quantile_cont(r, 0.75) AS c FROM v),
n AS (SELECT CASE WHEN r < a THEN 0 WHEN r < b THEN 1 WHEN r < c THEN 2 ELSE 3 END AS bin, r, e FROM v, q)
SELECT bin, count(*) AS n, min(r) AS lo, max(r) AS hi, {sq('quantile_cont(e, 0.5)', 4)} AS median FROM n GROUP BY 1""")
def _(t):
    rows = t.orders.select((F.col("o_orderkey") * 37 % 1000 / F.lit(1000.0)).alias("r"), F.col("o_totalprice").alias("e"))
    return ops.quartile_bins(rows, "r", "e").withColumn("median", F.round("median", 4) + 0.0)


@query("a32_duplicate_content", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_member, max(doc_id) AS last_member FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return ops.duplicate_content(t.documents, "doc_id", "text")


@query("a32_without_duplicates", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text) HAVING count(*) = 1")
def _(t):
    return ops.without_duplicates(t.documents, "doc_id", "text")


SPEED = "sp AS (SELECT l_orderkey, l_linenumber, (1 + l_linenumber)::DOUBLE AS nominal, (1 + l_linenumber) * (1 + (l_discount - l_tax) / 2) AS computed FROM lineitem)"


def speeds(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", (1 + F.col("l_linenumber")).cast("double").alias("nominal"),
                             ((1 + F.col("l_linenumber")) * (1 + (F.col("l_discount") - F.col("l_tax")) / 2)).alias("computed"))


@query("a33_speed_agreement", f"""WITH {SPEED} SELECT nominal, count(*) AS n, {sq('avg(computed)')} AS mean, {sq('stddev_samp(computed)')} AS sd, {sq('avg(computed - nominal)')} AS mean_error,
  {sq('quantile_cont(abs(100.0 * (computed - nominal) / nominal), 0.5)')} AS median_rel FROM sp GROUP BY 1""")
def _(t):
    out = ops.agreement(speeds(t), ["nominal"], F.col("nominal"), F.col("computed"))
    return rounded(out, ["nominal", "n"], ["mean", "sd", "mean_error", "median_rel"])


@query("p20_verdict_bands", f"""WITH {SPEED}, m AS (SELECT nominal, quantile_cont(abs(100.0 * (computed - nominal) / nominal), 0.5) AS m FROM sp GROUP BY 1)
SELECT nominal, {sq('m')} AS median_rel, CASE WHEN m <= 3 THEN 'pass' WHEN m <= 8 THEN 'usable' ELSE 'fail' END AS verdict FROM m""")
def _(t):
    out = ops.agreement(speeds(t), ["nominal"], F.col("nominal"), F.col("computed"))
    return out.select("nominal", r6(F.col("median_rel")).alias("median_rel"), ops.verdict_band(F.col("median_rel")).alias("verdict"))


@query("w25_worst_rows", f"""WITH {SPEED} SELECT l_orderkey * 10 + l_linenumber AS row_id, {sq('100.0 * (computed - nominal) / nominal')} AS rel_err FROM sp
ORDER BY round(abs(100.0 * (computed - nominal) / nominal), 9) DESC, row_id LIMIT 5""")
def _(t):
    rel = 100.0 * (F.col("computed") - F.col("nominal")) / F.col("nominal")
    rows = speeds(t).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), rel.alias("rel_err"))
    return rounded(ops.worst_rows(rows, F.col("rel_err"), "row_id", 5), ["row_id"], ["rel_err"])


@query("p21_tri_state_bar", f"""WITH {ROWS}, m AS (SELECT subject, joint, CASE WHEN count(*) >= 180 THEN avg(mae) END AS v FROM rws GROUP BY 1, 2)
SELECT subject, joint, v <= 3.55 AS met FROM m""")
def _(t):
    m = error_rows(t).groupBy("subject", "joint").agg(F.when(F.count(F.lit(1)) >= 180, F.avg("mae")).alias("v"))
    return m.select("subject", "joint", ops.tri_state(F.col("v"), 3.55).alias("met"))


@query("p23_first_usable", """SELECT l_orderkey AS trial, CASE WHEN count(CASE WHEN l_returnflag = 'R' THEN 1 END) > 0 THEN 'toe'
  WHEN count(CASE WHEN l_returnflag = 'A' THEN 1 END) > 0 THEN 'meta1' WHEN count(CASE WHEN l_linestatus = 'F' THEN 1 END) > 0 THEN 'meta5' END AS used FROM lineitem GROUP BY 1""")
def _(t):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("trial"), F.when(F.col("l_returnflag") == "R", F.col("l_tax")).alias("toe"),
        F.when(F.col("l_returnflag") == "A", F.col("l_tax")).alias("meta1"), F.when(F.col("l_linestatus") == "F", F.col("l_tax")).alias("meta5"))
    return ops.first_usable(rows, ["trial"], ["toe", "meta1", "meta5"])


ARMS = ROWS + ", arm AS (SELECT subject, limb, CASE camera % 3 WHEN 0 THEN 'perfect' WHEN 1 THEN 'detected' ELSE 'matched' END AS arm, mae FROM rws)"


def armed(t: Tables) -> DataFrame:
    return error_rows(t).withColumn("arm", F.expr("CASE camera % 3 WHEN 0 THEN 'perfect' WHEN 1 THEN 'detected' ELSE 'matched' END"))


@query("a36_arm_costs", f"""WITH {ARMS}, m AS (SELECT subject, limb, arm, avg(mae) AS v FROM arm GROUP BY 1, 2, 3)
SELECT a.subject, a.limb, a.arm, {sq('a.v')} AS value, {sq('a.v - b.v')} AS cost FROM m a JOIN m b ON a.subject = b.subject AND a.limb = b.limb AND b.arm = 'perfect' WHERE a.arm <> 'perfect'""")
def _(t):
    return rounded(ops.arm_costs(armed(t), ["subject", "limb"], "arm", "perfect", "mae"), ["subject", "limb", "arm"], ["value", "cost"])


@query("a37_hypothesis_verdict", f"""WITH {ARMS}, m AS (SELECT subject, limb, avg(mae) FILTER (WHERE arm = 'perfect') AS p, avg(mae) FILTER (WHERE arm = 'matched') AS q FROM arm GROUP BY 1, 2)
SELECT limb, count(*) AS n, count(*) FILTER (WHERE q <= p) AS n_meeting, count(*) FILTER (WHERE q <= p) >= 30 AS supported, bool_and(coalesce(q <= p, false)) AS all_meet FROM m GROUP BY 1""")
def _(t):
    wide = armed(t).groupBy("subject", "limb").pivot("arm", ["perfect", "matched"]).agg(F.avg("mae"))
    return ops.holds_on(wide, ["limb"], F.col("matched") <= F.col("perfect"), 30)


CALLS = """calls AS (SELECT user_id, event_type, CASE WHEN value < 5 THEN NULL WHEN event_id % 5 < 3 THEN 'l' ELSE 'r' END AS said, CASE WHEN event_id % 2 = 0 THEN 'l' ELSE 'r' END AS truth FROM events)"""


@query("a39_hit_rate", f"""WITH {CALLS} SELECT event_type, count(*) AS n, {sq("avg(CASE WHEN said = truth THEN 1.0 ELSE 0 END)")} AS hit_rate,
  {sq("avg(CASE WHEN said IS NOT NULL THEN CASE WHEN said = truth THEN 1.0 ELSE 0 END END)")} AS confident_rate, count(*) FILTER (WHERE said IS NULL) AS n_abstained FROM calls GROUP BY 1""")
def _(t):
    rows = t.events.select("event_type", F.when(F.col("value") >= 5, F.when(F.col("event_id") % 5 < 3, "l").otherwise("r")).alias("said"),
                           F.when(F.col("event_id") % 2 == 0, "l").otherwise("r").alias("truth"))
    return rounded(ops.hit_rate(rows, ["event_type"], "said", "truth"), ["event_type", "n", "n_abstained"], ["hit_rate", "confident_rate"])


@query("a40_sign_consistency", f"""WITH {SKEL}, c AS (SELECT clip, CASE WHEN avg(l_hip_z) < avg(r_hip_z) THEN 'l' ELSE 'r' END AS near FROM skel GROUP BY 1)
SELECT clip, near, {sq("avg(CASE WHEN (CASE WHEN l_hip_z < r_hip_z THEN 'l' ELSE 'r' END) = near THEN 1.0 ELSE 0 END)")} AS consistency FROM skel JOIN c USING (clip) GROUP BY 1, 2""")
def _(t):
    s = skeletons(t)
    call = F.when(F.col("l_hip")["z"] < F.col("r_hip")["z"], "l").otherwise("r")
    # The clip's call and the frame votes come from one aggregate; frames need not meet it.
    per = geo.near_limb(s, CLIP).join(s.groupBy("clip").agg(F.avg((call == "l").cast("double")).alias("_l")), "clip")
    return per.select("clip", "near", r6(F.when(F.col("near") == "l", F.col("_l")).otherwise(1 - F.col("_l"))).alias("consistency"))


@query("a42_candidate_choice", f"""WITH {ROWS}, c AS (SELECT subject, joint AS cand, avg(est - ref) AS m FROM rws GROUP BY 1, 2),
b AS (SELECT *, min(abs(m)) OVER (PARTITION BY subject) AS best FROM c),
k AS (SELECT subject, arg_min(cand, struct_pack(a := round(abs(m), 9), c := cand)) AS smallest, count(*) FILTER (WHERE abs(m) - best < 0.1) AS close,
  coalesce(bool_or(abs(m) - best < 0.1 AND cand = 'knee'), false) AS has FROM b GROUP BY 1)
SELECT subject, CASE WHEN close > 1 AND has THEN 'knee' ELSE smallest END AS chosen, CASE WHEN close <= 1 THEN 'smallest' WHEN has THEN 'tie: declared' ELSE 'tie: smallest kept' END AS reason FROM k""")
def _(t):
    stats = error_rows(t).groupBy("subject", F.col("joint").alias("cand")).agg(F.avg(F.col("est") - F.col("ref")).alias("m"))
    return ops.choose_candidate(stats, ["subject"], "cand", "m", "knee", 0.1)


# ---------------------------------------------------------------- joins over frames

@query("j07_rate_mapped_join", f"""WITH {CLIPS} SELECT v.user_id, v.frame, r.frame AS ref_frame, {sq('r.value')} AS ref_value
FROM clips v JOIN clips r ON r.user_id = v.user_id AND r.frame = 2 + 4 * v.frame""")
def _(t):
    """Frame i of a 30 Hz window against frame lo + 4·i of its 120 Hz reference."""
    frames = clip_frames(t).select("user_id", "frame", "value")
    video = frames.select("user_id", "frame", (2 + 4 * F.col("frame")).alias("ref_frame"))
    ref = frames.select("user_id", F.col("frame").alias("ref_frame"), r6(F.col("value")).alias("ref_value"))
    return video.join(ref, ["user_id", "ref_frame"]).select("user_id", "frame", "ref_frame", "ref_value")


@query("j08_length_matched", """WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT a.user_id, a.n AS n_frames FROM a JOIN b ON a.user_id = b.user_id AND a.n = b.n""")
def _(t):
    return joins.length_matched(t.events.filter("event_id % 2 = 0"), t.events.filter("event_id % 2 = 1"), ["user_id"])


DIMENSIONS, TOLERANCE = 34, 0.65


@query("j11_nearest_within", f"""WITH p AS (SELECT vec_id, list_transform(generate_series(1, {DIMENSIONS}), lambda i: embedding[i]::DOUBLE) AS v FROM embeddings),
d AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.v, b.v) AS d FROM p a JOIN p b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)
SELECT a AS clip_id, b AS match_id, {sq('d')} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rn FROM d WHERE d <= {TOLERANCE}) WHERE rn = 1""")
def _(t):
    v = t.embeddings.select("vec_id", F.slice("embedding", 1, DIMENSIONS).cast("array<double>").alias("v"))
    left = v.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("clip_id"), "v")
    right = v.filter("vec_id % 2 = 1").select(F.col("vec_id").alias("match_id"), "v")
    out = joins.match_within(left, right, "clip_id", "match_id", "v", TOLERANCE, [[float(i == j) for i in range(DIMENSIONS)] for j in range(3)])
    return rounded(out, ["clip_id", "match_id"], ["distance"])


# ------------------------------------------------------------------ order and windows

STILL = CLIPS + """,
seg AS (SELECT user_id, event_type AS motion, frame, row_number() OVER (PARTITION BY user_id, event_type ORDER BY frame) - 1 AS k, value FROM clips),
rn AS (SELECT user_id, motion, k - row_number() OVER (PARTITION BY user_id, motion ORDER BY k) AS g, k FROM seg WHERE value < 60),
best AS (SELECT user_id, motion, max(n) AS still FROM (SELECT user_id, motion, g, count(*) AS n FROM rn GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("w24_best_candidate", f"""WITH {STILL} SELECT user_id, motion, still FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY still DESC, motion) AS r FROM best) WHERE r = 1""")
def _(t):
    """Of each subject's motions, the one with the longest still run."""
    keys = ["user_id", "motion"]
    seg = number_frames(clip_frames(t).select("user_id", F.col("event_type").alias("motion"), F.col("frame").alias("_f"), "value"), keys, ["_f"])
    still = longest_run(seg, keys, F.col("value") < 60)
    best = still.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "motion")).alias("_b"))
    return best.select("user_id", F.col("_b")["motion"].alias("motion"), (-F.col("_b")["n"]).alias("still"))


@query("w26_longest_first", """WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, user_id) - 1 AS position, count(*) OVER () AS total FROM s),
k AS (SELECT *, greatest(1, (total - 10) // 10) AS step FROM r)
SELECT user_id, n, position FROM k WHERE position < 10 OR (position >= 10 AND (position - 10) % step = 0 AND (position - 10) // step < 10)""")
def _(t):
    sizes = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return ops.longest_first_sample(sizes, "user_id", "n", 20).select("user_id", "n", "position")


LENGTH = 18
_TRI = ", ".join(repr(w) for w in triangle(LENGTH))


@query("w21_window_blend", f"""WITH {CLIPS},
sz AS (SELECT user_id, count(*) AS n, arg_max(value, frame) AS tail FROM clips GROUP BY 1),
st AS (SELECT user_id, n, tail, unnest(list_distinct(list_concat(generate_series(0, greatest(n - {LENGTH}, 0), {LENGTH // 2}), [greatest(n - {LENGTH}, 0)]))) AS s FROM sz),
w AS (SELECT st.user_id, st.s, c.frame, c.value, list_extract(CAST([{_TRI}] AS DOUBLE[]), c.frame - st.s + 1) AS tw,
  (sum(c.value) OVER (PARTITION BY st.user_id, st.s) + ({LENGTH} - count(*) OVER (PARTITION BY st.user_id, st.s)) * tail) / {LENGTH} AS m
  FROM st JOIN clips c ON c.user_id = st.user_id AND c.frame >= st.s AND c.frame < st.s + {LENGTH})
SELECT user_id, frame, {sq('sum(tw * (value - m)) / sum(tw)')} AS blended, {sq('sum(tw)')} AS weight FROM w GROUP BY 1, 2""")
def _(t):
    """Window-wise centring, blended with triangular weights."""
    out = apply_windows(clip_frames(t), ["user_id"], "value", lambda w: w - w.mean(axis=1, keepdims=True), LENGTH)
    return rounded(out, ["user_id", "frame"], ["blended", "weight"])
