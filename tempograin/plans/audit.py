"""Audit queries: orders are clips, line items reported numbers, documents and pages texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin.functions.numeric import r6, r6_scaled
from tempograin.operators import audit as ops
from tempograin.operators.cohort import unpivot
from tempograin.operators.ordered import Ordered
from tempograin.plans.errors import ROWS, error_rows, sq
from tempograin.plans.geometry import CLIP, SKEL, TRAVEL, clip_skeletons
from tempograin.operators import geometry as geo
from tempograin.plans.registry import query
from tempograin.plans.series import CLIPS, clip_frames
from tempograin.sources.tables import Tables

CLIP_COLUMNS = {
    "clip": "o_orderkey", "subject": "o_custkey",
    "fps": "CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST(15 + o_orderkey % 60 AS DOUBLE) END",
    "width": "640 + o_orderkey % 400", "height": "300 + o_custkey % 400", "n_frames": "60 + (o_orderkey * 7) % 900",
    "n_detected": "(60 + (o_orderkey * 7) % 900) - CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey * 3) % 60 ELSE 0 END",
    "n_crowded": "CASE WHEN o_orderkey % 37 = 0 THEN 2 ELSE 0 END",
    "view_ratio": "CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE CAST(0.3 + (o_orderkey * 13 % 500) / CAST(1000 AS DOUBLE) AS DOUBLE) END"}
PROPS = "cl AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in CLIP_COLUMNS.items()) + " FROM orders)"
CHECKS = PROPS + """,
v AS (SELECT *, least(width, height)::DOUBLE AS short, CASE WHEN fps > 0 THEN n_frames / fps ELSE 0 END AS secs, 1.0 - n_detected / n_frames::DOUBLE AS miss FROM cl),
ck AS (
  SELECT clip, 'fps' AS name, CASE WHEN fps IS NULL OR fps < 25 THEN 'refuse' WHEN fps < 50 THEN 'warn' ELSE 'pass' END AS status, fps AS value FROM v
  UNION ALL SELECT clip, 'resolution', CASE WHEN short < 360 THEN 'refuse' WHEN short < 480 THEN 'warn' ELSE 'pass' END, short FROM v
  UNION ALL SELECT clip, 'length', CASE WHEN secs < 3 THEN 'refuse' WHEN secs < 8 THEN 'warn' ELSE 'pass' END, secs FROM v
  UNION ALL SELECT clip, 'person', CASE WHEN n_crowded > 0 OR miss > 0.2 THEN 'refuse' WHEN miss > 0 THEN 'warn' ELSE 'pass' END, miss FROM v
  UNION ALL SELECT clip, 'viewpoint', CASE WHEN view_ratio < 0.49 THEN 'refuse' WHEN view_ratio IS NULL OR view_ratio < 0.6 THEN 'warn' ELSE 'pass' END, view_ratio FROM v)"""


def clips(t: Tables) -> DataFrame:
    return t.orders.select(*[F.expr(e).alias(n) for n, e in CLIP_COLUMNS.items()], "o_totalprice")


@query("t07_input_checks", f"WITH {CHECKS} SELECT clip, name, status, {sq('value')} AS value FROM ck")
def _(t):
    long = clips(t).select("clip", F.inline(ops.input_checks()))
    return long.select("clip", "name", "status", r6(F.col("value")).alias("value"))


@query("t08_refusals_never_aggregate", f"""WITH {CHECKS},
w AS (SELECT clip, CASE WHEN bool_or(status = 'refuse') THEN 'refuse' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'pass' END AS verdict FROM ck GROUP BY 1)
SELECT verdict, count(*) AS n_clips, CASE WHEN verdict <> 'refuse' THEN {sq('avg(o_totalprice)', 4)} END AS mean_value FROM w JOIN orders ON o_orderkey = clip GROUP BY 1""")
def _(t):
    judged = clips(t).withColumn("verdict", ops.worst_status(ops.input_checks()))
    kept = F.when(F.col("verdict") != "refuse", F.col("o_totalprice"))
    return judged.groupBy("verdict").agg(F.count(F.lit(1)).alias("n_clips"), (F.round(F.avg(kept), 4) + 0.0).alias("mean_value"))


CONTRACT = """pa AS (SELECT user_id AS clip, CASE WHEN event_id % 101 = 0 THEN NULL ELSE value / 490 END AS x, CASE WHEN event_id % 89 = 0 THEN 0 ELSE value / 480 END AS y,
  CASE WHEN event_id % 61 = 0 THEN -0.1 ELSE 0.7 + (event_id % 30) / CAST(100 AS DOUBLE) END AS conf, event_id FROM events)"""


def prepared(t: Tables) -> DataFrame:
    e = t.events
    return e.select(F.col("user_id").alias("clip"), "event_id", F.when(F.col("event_id") % 101 != 0, F.col("value") / 490).alias("x"),
                    F.when(F.col("event_id") % 89 == 0, 0.0).otherwise(F.col("value") / 480).alias("y"),
                    F.when(F.col("event_id") % 61 == 0, -0.1).otherwise(0.7 + (F.col("event_id") % 30) / 100.0).alias("conf"))


@query("t09_contract_flags", f"""WITH {CONTRACT},
s AS (SELECT clip, count(*) AS n_frames, count(*) FILTER (WHERE x IS NULL OR y IS NULL OR conf IS NULL) AS bad, max(greatest(abs(x), abs(y))) AS mx, min(conf) AS lo, max(conf) AS hi, avg(conf) AS mean,
  count(*) FILTER (WHERE abs(x) + abs(y) = 0) AS zero FROM pa GROUP BY 1)
SELECT clip, n_frames, {sq('mean')} AS conf_mean, concat_ws('; ', CASE WHEN bad > 0 THEN 'non-finite values' END, CASE WHEN mx > 1 + 1e-6 THEN 'range exceeds 1' END,
  CASE WHEN lo < 0 OR hi > 1 THEN 'confidence outside [0, 1]' END, CASE WHEN abs(mean - 0.84) > 0.05 THEN 'confidence mean off target' END, CASE WHEN zero > 0 THEN 'all-zero frames' END) AS flags FROM s""")
def _(t):
    out = ops.contract_flags(prepared(t), ["clip"], "x", "y", "conf", 0.84, order=["event_id"])
    return out.select("clip", "n_frames", r6_scaled(F.col("conf_mean")).alias("conf_mean"), F.concat_ws("; ", "flags").alias("flags"))


@query("t09_image_flags", f"""WITH {CONTRACT},
s AS (SELECT clip, count(*) AS n_frames, count(*) FILTER (WHERE x IS NULL OR y IS NULL OR conf IS NULL) AS bad, max(abs(x)) AS mx, max(abs(y)) AS my, min(conf) AS lo, max(conf) AS hi, avg(conf) AS mean,
  count(*) FILTER (WHERE abs(x) + abs(y) = 0) AS zero, max(CASE WHEN clip % 7 <> 0 THEN 1080 / CAST(CASE WHEN clip % 2 = 0 THEN 1920 ELSE 1100 END AS DOUBLE) END) AS aspect FROM pa GROUP BY 1)
SELECT clip, n_frames, concat_ws('; ', CASE WHEN bad > 0 THEN 'non-finite values' END, CASE WHEN aspect IS NULL THEN 'no resolution' END, CASE WHEN aspect IS NOT NULL AND mx > 1 + 1e-3 THEN 'x outside the image' END,
  CASE WHEN my > aspect + 1e-3 THEN 'y outside the image' END, CASE WHEN lo < 0 OR hi > 1 THEN 'confidence outside [0, 1]' END,
  CASE WHEN abs(mean - 0.84) > 0.05 THEN 'confidence mean off target' END, CASE WHEN zero > 0 THEN 'all-zero frames' END) AS flags FROM s""")
def _(t):
    """The image-size form, with clips of unknown size."""
    clip = F.col("clip")
    sized = prepared(t).withColumns({"width": F.when(clip % 7 != 0, F.when(clip % 2 == 0, 1920).otherwise(1100)), "height": F.when(clip % 7 != 0, 1080)})
    out = ops.contract_flags(sized, ["clip"], "x", "y", "conf", 0.84, ("width", "height"), ["event_id"])
    return out.select("clip", "n_frames", F.concat_ws("; ", "flags").alias("flags"))


@query("t10_plausibility", f"""WITH {CLIPS},
d AS (SELECT user_id, value AS hip, value * 0.7 + (event_id % 40) AS knee, event_id % 9 AS score FROM clips),
s AS (SELECT user_id, avg(CASE WHEN hip NOT BETWEEN 0 AND 150 THEN 1.0 ELSE 0 END) AS oh, avg(CASE WHEN knee NOT BETWEEN 5 AND 160 THEN 1.0 ELSE 0 END) AS ok, corr(hip, knee) AS r, avg(score) AS ms FROM d GROUP BY 1)
SELECT user_id, {sq('r')} AS r, {sq('ms')} AS mean_score, concat_ws('; ', CASE WHEN oh > 0.05 THEN 'hip outside its band' END, CASE WHEN ok > 0.05 THEN 'knee outside its band' END,
  CASE WHEN r > 0.5 THEN 'sides move together' END, CASE WHEN ms < 4 THEN 'low score' END) AS warnings FROM s""")
def _(t):
    rows = t.events.select("user_id", F.col("value").alias("hip"), (F.col("value") * 0.7 + F.col("event_id") % 40).alias("knee"), (F.col("event_id") % 9).alias("score"))
    out = ops.plausibility(rows, ["user_id"], {"hip": (0.0, 150.0), "knee": (5.0, 160.0)}, "hip", "knee", "score", 4.0)
    return out.select("user_id", r6(F.col("r")).alias("r"), r6(F.col("mean_score")).alias("mean_score"), F.concat_ws("; ", "warnings").alias("warnings"))


GATES = """g AS (SELECT s_suppkey AS subject, CAST(s_suppkey AS STRING) AS named, CASE WHEN s_suppkey % 17 = 0 THEN CONCAT(CAST(s_suppkey AS STRING), 'x') ELSE CAST(s_suppkey AS STRING) END AS found,
  4 + (s_suppkey % 21 - 10) / CAST(100 AS DOUBLE) AS rate_ratio, 300 + s_acctbal / 50 AS thigh, CASE WHEN s_suppkey % 13 = 0 THEN 'y' ELSE 'z' END AS axis_a, CASE WHEN s_suppkey % 29 = 0 THEN NULL ELSE 'z' END AS axis_b FROM supplier)"""


@query("t11_gates", f"""WITH {GATES}
SELECT subject, concat_ws('; ', CASE WHEN named <> found THEN 'identity' END, CASE WHEN abs(rate_ratio - 4) >= 0.05 THEN 'rate' END, CASE WHEN thigh NOT BETWEEN 300 AND 480 THEN 'units' END,
  CASE WHEN axis_a <> axis_b THEN 'axis' END) AS failed, concat_ws('; ', CASE WHEN named <> found THEN 'identity' END, CASE WHEN abs(rate_ratio - 4) >= 0.05 THEN 'rate' END,
  CASE WHEN thigh NOT BETWEEN 300 AND 480 THEN 'units' END, CASE WHEN axis_a <> axis_b THEN 'axis' END) = '' AS scored FROM g""")
def _(t):
    body = GATES[GATES.index("SELECT") + 7:GATES.rindex(" FROM supplier)")]
    rows = t.supplier.selectExpr(*_split_columns(body))
    rules = {"identity": F.col("named") == F.col("found"), "rate": F.abs(F.col("rate_ratio") - 4) < 0.05,
             "units": F.col("thigh").between(300, 480), "axis": F.col("axis_a") == F.col("axis_b")}
    out = rows.withColumn("_f", ops.named_failures(rules))
    return out.select("subject", F.concat_ws("; ", "_f").alias("failed"), (F.size("_f") == 0).alias("scored"))


def _split_columns(text: str) -> list[str]:
    """Split a select list on its top-level commas."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, text[start:]]]


@query("t12_side_reconciliation", f"""WITH {SKEL}, {TRAVEL},
d AS (SELECT clip, dx, CASE clip % 4 WHEN 0 THEN ' Left' WHEN 1 THEN 'R' WHEN 2 THEN 'l' ELSE 'both' END AS declared FROM travel),
e AS (SELECT clip, CASE lower(trim(declared)) WHEN 'left' THEN 'l' WHEN 'l' THEN 'l' WHEN 'r' THEN 'r' WHEN 'right' THEN 'r' END AS near, CASE WHEN abs(dx) >= 0.01 THEN CASE WHEN dx > 0 THEN 'r' ELSE 'l' END END AS suggested FROM d)
SELECT clip, near, suggested, CASE WHEN near IS NULL THEN 'invalid side' WHEN suggested IS NULL THEN 'no suggestion' WHEN suggested <> near THEN 'disagreement' ELSE '' END AS warning FROM e""")
def _(t):
    travel = geo.travel_per_frame(clip_skeletons(t), CLIP)
    declared = F.element_at(F.array(F.lit(" Left"), F.lit("R"), F.lit("l"), F.lit("both")), (F.col("clip") % 4 + 1).cast("int"))
    return travel.select("clip", *[c.alias(n) for n, c in ops.reconcile_side(declared, F.col("dx_per_frame")).items()])


@query("t13_tolerance_regression", """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_extendedprice AS price, CAST(0 AS DOUBLE) AS dead, CAST(0 AS DOUBLE) AS gone FROM lineitem WHERE l_orderkey % 50 <> 0),
g AS (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_extendedprice * (1 + CASE WHEN l_orderkey % 9 = 0 THEN 0.001 ELSE 0.00001 END) AS price, l_tax AS dead, CAST(0 AS DOUBLE) AS gone FROM lineitem),
l AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS col, b.l_orderkey IS NOT NULL AND g.l_orderkey IS NOT NULL AS m, b.{c} AS e, g.{c} AS v FROM b FULL JOIN g ON b.l_orderkey = g.l_orderkey AND b.l_linenumber = g.l_linenumber"
    for c in ("quantity", "price", "dead", "gone")) + """),
s AS (SELECT col, count(*) FILTER (WHERE m) AS n_compared, count(*) FILTER (WHERE m AND abs(v - e) <= 1e-6 + 1e-4 * abs(e)) AS n_equal, count(*) FILTER (WHERE NOT m) AS n_unmatched, max(coalesce(abs(e), 0)) > 0 AS live, max(coalesce(abs(v), 0)) > 0 AS alive FROM l GROUP BY 1)
SELECT col AS "column", n_compared, n_equal, n_unmatched, live, NOT live AND alive AS revived, CASE WHEN live THEN n_equal = n_compared AND n_unmatched = 0 END AS passed FROM s""")
def _(t):
    keys, names = ["l_orderkey", "l_linenumber"], ["quantity", "price", "dead", "gone"]
    li = t.lineitem
    zero = F.lit(0.0)
    expected = li.filter("l_orderkey % 50 <> 0").select(*keys, F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), zero.alias("dead"), zero.alias("gone"))
    drift = 1 + F.when(F.col("l_orderkey") % 9 == 0, 0.001).otherwise(0.00001)
    got = li.select(*keys, F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") * drift).alias("price"), F.col("l_tax").alias("dead"), zero.alias("gone"))
    return ops.tolerance_regression(unpivot(expected, keys, names), unpivot(got, keys, names), keys)


@query("t14_best_label", """WITH c AS (SELECT l_orderkey AS session, l_tax AS ref, CASE WHEN l_orderkey % 3 = 0 THEN l_tax ELSE l_discount END AS walk, CASE WHEN l_orderkey % 3 = 1 THEN l_tax ELSE l_tax + CASE WHEN l_linenumber = 2 THEN 0.01 ELSE 0 END END AS run FROM lineitem),
p AS (SELECT session, 'run' AS label, ref, run AS got FROM c UNION ALL SELECT session, 'walk', ref, walk FROM c),
a AS (SELECT session, label, count(*) FILTER (WHERE ref <> 0) AS n_live, count(*) FILTER (WHERE ref <> 0 AND abs(got - ref) <= 1e-6 + 1e-4 * abs(ref)) AS n_agree FROM p GROUP BY 1, 2)
SELECT session, label AS label_used, n_live, n_agree, n_agree = n_live AND n_live > 0 AS resolved FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n_agree DESC, label) AS rn FROM a) WHERE rn = 1""")
def _(t):
    walk = F.when(F.col("l_orderkey") % 3 == 0, F.col("l_tax")).otherwise(F.col("l_discount"))
    run = F.when(F.col("l_orderkey") % 3 == 1, F.col("l_tax")).otherwise(F.col("l_tax") + F.when(F.col("l_linenumber") == 2, 0.01).otherwise(0.0))
    rows = t.lineitem.select(F.col("l_orderkey").alias("session"), F.col("l_tax").alias("ref"), F.inline(F.array(
        F.struct(F.lit("run").alias("label"), run.alias("got")), F.struct(F.lit("walk").alias("label"), walk.alias("got")))))
    return ops.best_label(rows, "session", "label", "ref", "got")


@query("t15_axis_identification", """WITH p AS (SELECT vec_id, k AS plane, list_max(embedding[k * 16 + 1:k * 16 + 16])::DOUBLE AS mx, list_min(embedding[k * 16 + 1:k * 16 + 16])::DOUBLE AS mn,
  list_max(embedding[17:32])::DOUBLE * 2 + embedding[60]::DOUBLE / 10 AS y FROM embeddings, (SELECT unnest(generate_series(0, 3))::INTEGER AS k)),
r AS (SELECT plane, 'max' AS extremum, corr(mx, y) AS r FROM p GROUP BY 1 UNION ALL SELECT plane, 'min', corr(mn, y) FROM p GROUP BY 1)
SELECT plane, extremum, round(r, 6) + 0.0 AS r, round(abs(r), 9) >= 0.9 AS identified FROM r ORDER BY round(abs(r), 9) DESC, plane, extremum DESC LIMIT 1""")
def _(t):
    y = F.array_max(F.slice("embedding", 17, 16)).cast("double") * 2 + F.col("embedding")[59].cast("double") / 10
    planes = F.array(*[F.struct(F.lit(k).alias("plane"), F.slice("embedding", k * 16 + 1, 16).alias("curve")) for k in range(4)])
    rows = t.embeddings.select("vec_id", y.alias("target"), F.inline(planes))
    return ops.identify_axis(rows, [], "plane", "curve", "target").withColumn("r", r6(F.col("r")))


# Words the invented documents do contain, each plain enough to mean the same to both engines.
TERMS = {"license": "licen[cs]e", "secret": "secret|password|api[_-]?key", "copyright": "copyright"}
MARKED = "CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), CONCAT(' # vocab-ok: quoted', chr(10))) WHEN doc_id % 3 = 1 THEN replace(text, chr(10), CONCAT(' # vocab-ok:', chr(10))) ELSE text END"
LINES = f"""ln AS (SELECT doc_id, i AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM (
  SELECT doc_id, string_split_regex({MARKED}, '\\r\\n|\\n|\\r') AS l FROM documents)))"""


def document_lines(t: Tables) -> DataFrame:
    return ops.lines(t.documents.select("doc_id", F.expr(MARKED.replace("chr(10)", "'\\n'")).alias("text")), "doc_id", "text")


@query("t16_banned_terms", f"WITH {LINES}, op AS (SELECT * FROM ln WHERE NOT regexp_matches(line, '#\\s*vocab-ok:\\s*\\S')) " + " UNION ALL ".join(
    f"SELECT doc_id, line_no::INTEGER AS line_no, '{n}' AS term FROM op WHERE regexp_matches(line, '(?i){p}')" for n, p in TERMS.items()))
def _(t):
    return ops.banned_terms(document_lines(t), "doc_id", TERMS, "vocab-ok")


@query("t16_pragma_problems", f"""WITH {LINES}, mk AS (SELECT doc_id, line_no::INTEGER AS line_no, trim(regexp_extract(line, '#\\s*vocab-ok:?(.*)$', 1)) AS reason, regexp_extract(line, '^(.*?)#\\s*vocab-ok', 1) AS before FROM ln WHERE regexp_matches(line, '#\\s*vocab-ok'))
SELECT doc_id, line_no, CASE WHEN reason = '' THEN 'no reason' ELSE 'not needed' END AS problem FROM mk WHERE reason = '' OR NOT (""" + " OR ".join(f"regexp_matches(before, '(?i){p}')" for p in TERMS.values()) + ")")
def _(t):
    return ops.pragma_problems(document_lines(t), "doc_id", TERMS, "vocab-ok")


HTML_TERMS = {**ops.BANNED, "nav": "<nav>"}


@query("t17_html_audit", "WITH ln AS (SELECT page_id, i AS line_no, l[i] AS line FROM (SELECT page_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT page_id, string_split_regex(html, '\\r\\n|\\n|\\r') AS l FROM pages))) " + " UNION ALL ".join(
    f"SELECT page_id, line_no::INTEGER AS line_no, '{n}' AS term FROM ln WHERE regexp_matches(line, '(?i){p}')" for n, p in {**HTML_TERMS, "script": "<script"}.items()))
def _(t):
    """Reports get no exemption, and may carry no script."""
    return ops.banned_terms(ops.lines(t.pages, "page_id", "html"), "page_id", {**HTML_TERMS, "script": "<script"}, None)


@query("t17_forbidden_sibling", """WITH n AS (SELECT page_id, regexp_replace(url, '\\?.*$', '') AS stem FROM pages),
d AS (SELECT DISTINCT concat(regexp_replace(url, '\\?.*$', ''), '-debug') AS stem FROM pages WHERE page_id % 7 = 0)
SELECT page_id, stem AS name FROM n WHERE concat(stem, '-debug') IN (SELECT stem FROM d)""")
def _(t):
    stem = F.regexp_replace("url", r"\?.*$", "")
    pages = t.pages.select("page_id", stem.alias("name"))
    debug = t.pages.filter("page_id % 7 = 0").select(F.concat(stem, F.lit("-debug")).alias("_debug"))
    return pages.join(debug, F.concat("name", F.lit("-debug")) == F.col("_debug"), "left_semi")


@query("t18_sparkline", f"""WITH {CLIPS}, s AS (SELECT user_id, count(*) AS n FROM clips GROUP BY 1),
k AS (SELECT user_id, n, unnest(generate_series(0, least(20, n) - 1)) AS j FROM s),
c AS (SELECT k.user_id, c.frame, c.value FROM k JOIN clips c ON c.user_id = k.user_id AND c.frame = CAST(floor(k.j * (k.n - 1) / greatest(least(20, k.n) - 1, 1)::DOUBLE + 1e-9) AS BIGINT)),
m AS (SELECT user_id, min(value) AS lo, max(value) AS hi FROM c GROUP BY 1)
SELECT user_id, CASE WHEN count(*) < 2 THEN '(no signal)' ELSE string_agg(substr('_.-~=*#@', CAST(coalesce(round_even((value - lo) / nullif(hi - lo, 0) * 7, 0), 0) AS INTEGER) + 1, 1), '' ORDER BY frame) END AS spark FROM c JOIN m USING (user_id) GROUP BY 1""")
def _(t):
    frames = clip_frames(t).select("user_id", "frame", "value")
    return ops.sparkline(Ordered(frames, ["user_id"], ["frame"]), ["user_id"], "value", 20)


# ---------------------------------------------------------------------------- the budget

def result_documents(t: Tables) -> DataFrame:
    """One nested JSON result document per supplier: pooled/<quantity>/<limb> and penalty."""
    cell = error_rows(t).groupBy("subject", "joint", "limb").agg(
        F.round(F.avg("mae"), 4).alias("mae"), F.round(F.avg(F.col("est") - F.col("ref")), 4).alias("bias"))

    def block(joint: str, value: str):
        return F.struct(*[F.max(F.when((F.col("joint") == joint) & (F.col("limb") == limb), F.col(value))).alias(limb) for limb in ("near", "far")])
    per = cell.groupBy("subject").agg(*[block(j, "mae").alias(f"m_{j}") for j in ("hip", "knee", "ankle")], *[block(j, "bias").alias(f"b_{j}") for j in ("hip", "knee")])
    built = F.to_json(F.struct(F.struct(*[F.col(f"m_{j}").alias(j) for j in ("hip", "knee", "ankle")]).alias("pooled"),
                               F.struct(*[F.col(f"b_{j}").alias(j) for j in ("hip", "knee")]).alias("penalty")))
    return per.select(F.concat(F.lit("supplier-"), F.col("subject").cast("string")).alias("file"), built.alias("json"))


def flat_results(t: Tables) -> DataFrame:
    """(file, path, value) of every number in the result documents."""
    docs = result_documents(t).select("file", F.parse_json("json").alias("_v"), F.lit("").alias("path"))
    tvf = t.spark.tvf
    for _ in range(3):
        docs = docs.lateralJoin(tvf.variant_explode(F.col("_v").outer())).select(
            "file", F.col("value").alias("_v"), F.concat_ws("/", F.nullif("path", F.lit("")), "key").alias("path"))
    return docs.select("file", "path", F.try_variant_get("_v", "$", "double").alias("value")).filter(F.col("value").isNotNull())


FLAT = ROWS + """,
ce AS (SELECT subject, joint, limb, round(avg(mae), 4) AS m, round(avg(est - ref), 4) AS b FROM rws GROUP BY 1, 2, 3),
flat AS (SELECT 'supplier-' || subject AS file, 'pooled/' || joint || '/' || limb AS path, m AS value FROM ce
  UNION ALL SELECT 'supplier-' || subject, 'penalty/' || joint || '/' || limb, b FROM ce WHERE joint <> 'ankle'),
files AS (SELECT DISTINCT file FROM flat)"""
ROW_PATHS = {"A": "best/{q}/{limb}", "B": "pooled/{q}/{limb}", "C": "penalty/{q}/{limb}"}
QUANTITIES = ["hip", "knee", "foot"]
CELLS = FLAT + ",\ncells AS (" + " UNION ALL ".join(
    f"SELECT f.file, '{r}' AS row, '{p.format(q=q, limb=limb)}' AS path, '{q}' AS quantity, '{limb}' AS limb, x.value FROM files f LEFT JOIN flat x ON x.file = f.file AND x.path = '{p.format(q=q, limb=limb)}'"
    for r, p in ROW_PATHS.items() for q in QUANTITIES for limb in ("near", "far")) + ")"


def cells(t: Tables) -> DataFrame:
    flat = flat_results(t)
    return ops.budget_cells(flat, ROW_PATHS, QUANTITIES, ["near", "far"], flat.select("file").distinct())


@query("t02_pointer_lookup", f"""WITH {FLAT} SELECT f.file, p.path, x.value, x.value IS NULL AS missing FROM files f CROSS JOIN (SELECT unnest(['pooled/hip/near', 'pooled/foot/near', 'penalty/knee/far']) AS path) p
LEFT JOIN flat x ON x.file = f.file AND x.path = p.path""")
def _(t):
    flat = flat_results(t)
    wanted = flat.select("file").distinct().withColumn("path", F.explode(F.array(*[F.lit(p) for p in ("pooled/hip/near", "pooled/foot/near", "penalty/knee/far")])))
    return ops.resolve_paths(flat, wanted)


@query("t03_budget_cells", f"WITH {CELLS} SELECT file, row, quantity, limb, path, value, value IS NULL AS missing FROM cells")
def _(t):
    return cells(t).select("file", "row", "quantity", "limb", "path", "value", "missing")


DECLARED = """de AS (SELECT 'supplier-' || s_suppkey AS file, CASE WHEN s_suppkey % 2 = 0 THEN 'l' ELSE 'r' END AS near_side, CASE s_suppkey % 3 WHEN 0 THEN 30.009 WHEN 1 THEN 60.0 ELSE 25.0 END AS fps FROM supplier)"""


@query("t04_quotes", f"""WITH {CELLS}, {DECLARED},
q AS (SELECT d.file, s.side, CASE WHEN s.side = d.near_side THEN 'near' ELSE 'far' END AS limb, d.fps FROM de d CROSS JOIN (SELECT unnest(['l', 'r']) AS side) s)
SELECT q.file, q.side, q.limb, c.quantity, c.value, concat_ws('; ', CASE WHEN c.value IS NULL THEN 'no cell' END, CASE WHEN c.value IS NOT NULL AND fps > 30.5 THEN 'faster than measured' END, CASE WHEN c.value IS NOT NULL AND fps < 29.5 THEN 'slower than measured' END) AS notes
FROM q JOIN cells c ON c.file = q.file AND c.limb = q.limb AND c.row = 'B'""")
def _(t):
    key = F.col("s_suppkey")
    declared = t.supplier.select(F.concat(F.lit("supplier-"), key.cast("string")).alias("file"), F.when(key % 2 == 0, "l").otherwise("r").alias("near_side"),
                                 F.when(key % 3 == 0, 30.009).when(key % 3 == 1, 60.0).otherwise(25.0).alias("fps"))
    out = ops.quote(cells(t), declared)
    return out.select("file", "side", "limb", "quantity", "value", F.concat_ws("; ", "notes").alias("notes"))


SHOWN = """shown AS (SELECT file, value AS shown FROM cells WHERE row = 'B' AND value IS NOT NULL AND limb = 'near'
  UNION SELECT b.file, round(b.value + 0.5 * c.value, 5) FROM cells b JOIN cells c ON b.file = c.file AND b.row = 'B' AND c.row = 'C' AND b.quantity = 'hip' AND c.quantity = 'knee' AND b.limb = 'near' AND c.limb = 'far' WHERE b.value IS NOT NULL AND c.value IS NOT NULL
  UNION SELECT file, round(value + 7.7, 4) FROM cells WHERE row = 'B' AND quantity = 'knee' AND value IS NOT NULL)"""


def shown(t: Tables) -> DataFrame:
    c = cells(t)
    b = c.filter("row = 'B' and value is not null")
    moved = (b.filter("quantity = 'hip' and limb = 'near'").select("file", F.col("value").alias("_b"))
             .join(c.filter("row = 'C' and quantity = 'knee' and limb = 'far' and value is not null").select("file", F.col("value").alias("_c")), "file")
             .select("file", F.round(F.col("_b") + 0.5 * F.col("_c"), 5).alias("shown")))
    exact = b.filter("limb = 'near'").select("file", F.col("value").alias("shown"))
    far_off = b.filter("quantity = 'knee'").select("file", F.round(F.col("value") + 7.7, 4).alias("shown"))
    return exact.unionByName(moved).unionByName(far_off).distinct()


@query("t05_provenance", f"WITH {CELLS}, {SHOWN} SELECT s.file, s.shown FROM shown s WHERE EXISTS (SELECT 1 FROM cells c WHERE c.file = s.file AND c.row = 'B' AND c.value = s.shown)")
def _(t):
    cited = cells(t).filter("row = 'B' and value is not null").select("file", F.col("value").alias("shown"))
    return shown(t).join(cited, ["file", "shown"], "left_semi")


@query("t06_forbidden_combination", f"""WITH {CELLS}, {SHOWN},
loose AS (SELECT s.* FROM shown s WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.file = s.file AND c.row = 'B' AND c.value = s.shown)),
su AS (SELECT b.file, b.value + k.k * c.value AS v FROM cells b JOIN cells c ON b.file = c.file AND b.row = 'B' AND c.row = 'C' AND abs(c.value) > 0.005 CROSS JOIN (SELECT unnest([1.0, -1.0, 0.5, -0.5, 0.1, -0.1]::DOUBLE[]) AS k) k WHERE b.value IS NOT NULL)
SELECT l.file, l.shown, coalesce(bool_or(round(abs(l.shown - su.v), 9) <= 0.005), false) AS combination FROM loose l LEFT JOIN su ON su.file = l.file GROUP BY 1, 2""")
def _(t):
    return ops.unsupported_numbers(shown(t), cells(t))


@query("j19_evidence_table", f"""WITH {FLAT}
SELECT 'error' AS grp, file, path, value FROM flat WHERE path LIKE 'pooled/%/near' UNION ALL SELECT 'penalty', file, path, value FROM flat WHERE path LIKE 'penalty/%/near'""")
def _(t):
    flat = flat_results(t)
    parts = [flat.filter(F.col("path").like(p)).select(F.lit(n).alias("grp"), "file", "path", "value") for n, p in (("error", "pooled/%/near"), ("penalty", "penalty/%/near"))]
    return parts[0].unionByName(parts[1])
