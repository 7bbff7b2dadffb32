"""Cohort queries: every order is a session of its customer, with untidy metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin.functions import text as tx
from tempograin.functions.numeric import r6
from tempograin.operators import cohort as ops
from tempograin.operators import joins
from tempograin.plans.registry import query
from tempograin.sources import sinks
from tempograin.sources.tables import Tables

# The untidy session columns, derived from orders and customer by expressions that mean
# the same in both engines.
DAY = "substr(CAST(o_orderdate AS STRING), 1, 10)"
SESSION_COLUMNS = {
    "sub_id": "CAST(o_custkey AS STRING)",
    "filename": "CONCAT(CAST(o_orderkey AS STRING), '.json')",
    "datestring": f"""CASE WHEN o_orderkey % 41 = 0 THEN 'NaN' WHEN o_orderkey % 3 = 0 THEN {DAY}
        WHEN o_orderkey % 3 = 1 THEN CONCAT({DAY}, ' 08:30:00')
        ELSE CONCAT(substr({DAY}, 6, 2), '/', substr({DAY}, 9, 2), '/', substr({DAY}, 1, 4)) END""",
    "injdefn": """CASE WHEN o_orderstatus = 'O' THEN 'No  injury' WHEN o_orderkey % 11 = 0 THEN ' '
        WHEN o_orderkey % 11 = 1 THEN 'null' WHEN o_orderkey % 3 = 0 THEN 'Minor'
        WHEN o_orderkey % 3 = 1 THEN ' MODERATE ' ELSE 'two workouts missed' END""",
    "injjoint": """CASE o_orderkey % 5 WHEN 0 THEN 'Knee' WHEN 1 THEN 'No injury,No injury' WHEN 2 THEN 'NaN'
        WHEN 3 THEN 'Foot, none' ELSE ' No  Injury ' END""",
    "specinjury": """CASE o_orderpriority WHEN '1-URGENT' THEN 'ITBS' WHEN '2-HIGH' THEN ' pfps '
        WHEN '3-MEDIUM' THEN '' WHEN '4-NOT SPECIFIED' THEN 'N/A'
        ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Knee  OA' ELSE 'No injury,No injury' END END""",
    "age": "CASE WHEN o_orderkey % 13 = 0 THEN '255' WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE CAST(18 + o_custkey % 60 AS STRING) END",
    "height": "CASE WHEN o_orderkey % 19 = 0 THEN '999' WHEN o_orderkey % 23 = 0 THEN 'NaN' ELSE CAST(150 + o_custkey % 50 AS STRING) END",
    "weight": "CASE WHEN o_orderkey % 29 = 0 THEN '1564' WHEN o_orderkey % 31 = 0 THEN '' ELSE CAST(45 + o_custkey % 70 AS STRING) END",
    "speed": "CASE WHEN o_orderkey % 7 = 0 THEN '0' ELSE CAST(1 + o_orderkey % 6 AS STRING) END",
    "years": "CASE WHEN o_orderkey % 9 = 0 THEN '999' WHEN o_orderkey % 9 = 1 THEN 'null' ELSE CAST(o_custkey % 40 AS STRING) END",
    "gender": "CASE WHEN c_custkey % 20 = 0 THEN 'Unknown' WHEN c_custkey % 2 = 0 THEN ' Male' ELSE 'FEMALE ' END",
    "level": "CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'N/A' WHEN o_orderkey % 3 = 0 THEN 'Recreational' ELSE 'Competitive ' END",
}
NUMERIC = list(tx.PLAUSIBLE)


def sessions(t: Tables) -> DataFrame:
    """Session metadata: all text, with the dataset's spellings of absent."""
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(*[F.expr(e).alias(n) for n, e in SESSION_COLUMNS.items()])


def cohort(t: Tables) -> DataFrame:
    return ops.prepare(sessions(t))


_TOKENS = "('', 'nan', 'null', 'n/a', 'none')"
_NO_INJURY = "('', 'nan', 'null', 'n/a', 'none', 'no injury')"


def _norm(c: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '\\s+', ' ', 'g'))"


def _no_injury(c: str) -> str:
    return (f"(len(list_filter(string_split({_norm(c)}, ','), lambda p: trim(p) NOT IN {_NO_INJURY})) = 0)")


def _merged(c: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.SYNONYMS.items())
    return f"CASE {_norm(c)} {cases} ELSE {_norm(c)} END"


def _num(c: str) -> str:
    return f"CASE WHEN NOT isnan(try_cast(trim({c}) AS DOUBLE)) THEN try_cast(trim({c}) AS DOUBLE) END"


def _status() -> str:
    return (f"CASE WHEN {_norm('injdefn')} = 'no injury' AND {_no_injury('injjoint')} AND {_no_injury('specinjury')} "
            f"THEN 'uninjured' WHEN NOT {_no_injury('specinjury')} OR {_norm('injdefn')} NOT IN {_NO_INJURY} "
            f"THEN 'injured' ELSE 'unknown' END")


SESSIONS = "sessions AS (SELECT " + ", ".join(
    f"{e} AS {n}" for n, e in SESSION_COLUMNS.items()) + " FROM orders JOIN customer ON o_custkey = c_custkey)"
_DATED = """coalesce(try_strptime(trim(datestring), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(datestring), '%Y-%m-%d'),
  try_strptime(trim(datestring), '%m/%d/%Y'))"""
COHORT = SESSIONS + ", cohort0 AS (SELECT sub_id, filename, datestring, injdefn, injjoint, specinjury, " + _DATED + \
    " AS dated, " + _status() + " AS status, " + _merged("specinjury") + " AS injury, " + ", ".join(
        f"CASE WHEN {_num(c)} BETWEEN {lo} AND {hi} THEN {_num(c)} END AS {c}" for c, (lo, hi) in tx.PLAUSIBLE.items()) + \
    f", CASE WHEN {_num('years')} BETWEEN 0 AND 80 THEN 0 ELSE 1 END AS years_missing" \
    f", CASE WHEN {_norm('level')} IN {_TOKENS} THEN 1 ELSE 0 END AS level_missing" \
    f", CASE WHEN {_norm('gender')} IN {_TOKENS} THEN 'missing' ELSE {_norm('gender')} END AS gender" \
    f", CASE WHEN {_norm('level')} IN {_TOKENS} THEN 'missing' ELSE {_norm('level')} END AS level FROM sessions)" + \
    ", cohort AS (SELECT *, CAST(year(dated) AS INTEGER) AS wave, CASE status WHEN 'injured' THEN 1 WHEN 'uninjured' THEN 0 END AS label FROM cohort0)"


def _first(columns: list[str], by: str = "sub_id") -> str:
    """First non-null value per column, over each group's dated order."""
    return ", ".join(
        f"arg_min({c}, struct_pack(a := dated IS NULL, b := coalesce(dated, TIMESTAMP '1900-01-01'), c := filename)) "
        f"FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in columns)


@query("s07_feature_table", """SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice FROM orders""")
def _(t):
    features = t.orders.select("o_orderkey", "o_custkey", r6(F.col("o_totalprice")).alias("o_totalprice"))
    return sinks.rewritten_parquet(features, "features")


@query("p01_text_normalise", f"""WITH {SESSIONS}
SELECT filename, {_norm('injdefn')} AS definition, {_norm('gender')} AS gender FROM sessions""")
def _(t):
    return sessions(t).select("filename", tx.normalise(F.col("injdefn")).alias("definition"),
                              tx.normalise(F.col("gender")).alias("gender"))


@query("p02_null_token", f"""WITH {SESSIONS}
SELECT filename, {_norm('level')} IN {_TOKENS} AS level_blank, {_norm('specinjury')} IN {_TOKENS} AS diagnosis_blank
FROM sessions""")
def _(t):
    return sessions(t).select("filename", tx.is_blank(F.col("level")).alias("level_blank"),
                              tx.is_blank(F.col("specinjury")).alias("diagnosis_blank"))


@query("p03_no_injury", f"""WITH {SESSIONS}
SELECT filename, {_no_injury('injjoint')} AS joint_clear, {_no_injury('specinjury')} AS diagnosis_clear FROM sessions""")
def _(t):
    return sessions(t).select("filename", tx.is_no_injury(F.col("injjoint")).alias("joint_clear"),
                              tx.is_no_injury(F.col("specinjury")).alias("diagnosis_clear"))


@query("p04_synonym_merge", f"""WITH {SESSIONS}
SELECT filename, {_merged('specinjury')} AS injury FROM sessions""")
def _(t):
    return sessions(t).select("filename", tx.merge_synonyms(F.col("specinjury")).alias("injury"))


@query("p05_lenient_number", f"""WITH {SESSIONS}
SELECT filename, {_num('age')} AS age, {_num('height')} AS height, {_num('datestring')} AS not_a_number FROM sessions""")
def _(t):
    return sessions(t).select("filename", *[tx.to_number(F.col(c)).alias(a) for c, a in
                                            (("age", "age"), ("height", "height"), ("datestring", "not_a_number"))])


@query("p06_range_mask", f"WITH {COHORT} SELECT filename, " + ", ".join(NUMERIC) + " FROM cohort")
def _(t):
    return cohort(t).select("filename", *NUMERIC)


@query("p07_three_state_label", f"WITH {COHORT} SELECT filename, status, label FROM cohort")
def _(t):
    return cohort(t).select("filename", "status", "label")


@query("p08_missing_flags", f"WITH {COHORT} SELECT filename, years_missing, level_missing FROM cohort")
def _(t):
    return cohort(t).select("filename", "years_missing", "level_missing")


@query("p09_missing_level", f"WITH {COHORT} SELECT filename, gender, level FROM cohort")
def _(t):
    return cohort(t).select("filename", "gender", "level")


@query("p10_collection_wave", f"WITH {COHORT} SELECT filename, wave FROM cohort")
def _(t):
    return cohort(t).select("filename", "wave")


@query("p11_dead_columns", """WITH v AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_tax * (CASE WHEN l_linenumber <= 4 THEN 0 ELSE 1 END) AS dead, l_discount AS live FROM lineitem),
r AS (SELECT avg(CASE WHEN dead = 0 THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN live = 0 THEN 1.0 ELSE 0 END) AS b FROM v)
SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS l_quantity, round(CASE WHEN a > 0.2 THEN nullif(dead, 0) ELSE dead END, 6) AS dead,
       round(CASE WHEN b > 0.2 THEN nullif(live, 0) ELSE live END, 6) AS live FROM v, r""")
def _(t):
    dead = F.col("l_tax") * F.when(F.col("l_linenumber") <= 4, 0).otherwise(1)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", dead.alias("dead"), F.col("l_discount").alias("live"))
    out = ops.mask_dead_columns(rows, ["l_quantity", "dead", "live"])
    return out.select("l_orderkey", "l_linenumber", *[r6(F.col(c)).alias(c) for c in ("l_quantity", "dead", "live")])


@query("p12_unusable_rate", f"WITH {COHORT} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS n_unusable, "
    f"round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END), 6) AS rate FROM cohort" for c in NUMERIC))
def _(t):
    return ops.unusable_rate(cohort(t), NUMERIC).withColumn("rate", r6(F.col("rate")))


@query("p13_sub_cohort", f"""WITH {COHORT},
sides AS (SELECT sub_id, count(*) AS n FROM cohort GROUP BY 1)
SELECT filename, sub_id, wave FROM cohort JOIN sides USING (sub_id)
WHERE wave BETWEEN 1995 AND 1997 AND n >= 5 AND {_norm('injjoint')} = 'knee'""")
def _(t):
    c = cohort(t)
    enough = c.groupBy("sub_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5").select("sub_id")
    return (c.filter(F.col("wave").between(1995, 1997) & (tx.normalise(F.col("injjoint")) == "knee"))
            .join(enough, "sub_id", "left_semi").select("filename", "sub_id", "wave"))


@query("p19_severity_ladder", f"""WITH {SESSIONS},
ranked AS (SELECT CASE {_norm('injdefn')} WHEN 'no injury' THEN 0 WHEN 'minor' THEN 1 WHEN 'moderate' THEN 2 WHEN 'severe' THEN 3 END AS severity
           FROM sessions)
SELECT severity, count(*) AS n, severity IS NOT NULL AS on_ladder FROM ranked GROUP BY 1, 3""")
def _(t):
    ranked = sessions(t).select(tx.severity_rank(F.col("injdefn")).alias("severity"))
    return ranked.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).withColumn("on_ladder", F.col("severity").isNotNull())


@query("j01_inner_join", """SELECT l.l_orderkey, l.l_linenumber, o.o_custkey, c.c_mktsegment, round(l.l_extendedprice, 6) AS price
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey""")
def _(t):
    return (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .select("l_orderkey", "l_linenumber", "o_custkey", "c_mktsegment", r6(F.col("l_extendedprice")).alias("price")))


@query("j02_left_coverage", """SELECT count(*) AS n_left, count(*) AS n_joined, count(l.doc_id) AS n_matched,
  round(count(l.doc_id)::DOUBLE / count(*), 6) AS coverage, true AS complete
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(t):
    return joins.coverage_join(t.documents, t.labels, ["doc_id"]).withColumn("coverage", r6(F.col("coverage")))


RUN_WALK = SESSIONS + """,
run AS (SELECT sub_id, filename, speed, 'run' AS mode FROM sessions WHERE CAST(sub_id AS BIGINT) % 3 <> 0),
walk AS (SELECT sub_id, filename, NULL AS speed, 'walk' AS mode FROM sessions WHERE CAST(sub_id AS BIGINT) % 3 <> 1)"""


def run_walk(t: Tables) -> tuple[DataFrame, DataFrame]:
    s = sessions(t)
    group = F.col("sub_id").cast("long") % 3
    return (s.filter(group != 0).select("sub_id", "filename", "speed", F.lit("run").alias("mode")),
            s.filter(group != 1).select("sub_id", "filename", F.lit("walk").alias("mode")))


@query("j03_prefer_union", f"""WITH {RUN_WALK}
SELECT * FROM run UNION ALL SELECT w.* FROM walk w
WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.sub_id = w.sub_id AND r.filename = w.filename)""")
def _(t):
    run, walk = run_walk(t)
    return joins.prefer_union(run, walk, ["sub_id", "filename"])


@query("j04_lookup", f"""WITH {RUN_WALK}
SELECT w.sub_id, w.filename, r.speed AS run_speed FROM walk w LEFT JOIN run r USING (sub_id, filename)""")
def _(t):
    run, walk = run_walk(t)
    lookup = run.select("sub_id", "filename", F.col("speed").alias("run_speed"))
    return walk.join(lookup, ["sub_id", "filename"], "left").select("sub_id", "filename", "run_speed")


@query("j05_semi_join", f"""WITH {RUN_WALK}
SELECT DISTINCT sub_id FROM run INTERSECT SELECT sub_id FROM walk""")
def _(t):
    run, walk = run_walk(t)
    return run.select("sub_id").intersect(walk.select("sub_id"))


@query("a01_status_counts", f"""WITH {COHORT}
SELECT status, count(*) AS sessions, count(DISTINCT sub_id) AS subjects FROM cohort GROUP BY 1""")
def _(t):
    per = cohort(t).groupBy("status", "sub_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("status").agg(F.sum("n").alias("sessions"), F.count(F.lit(1)).alias("subjects"))


_MEANS = ["age", "height", "weight", "speed"]
DEMOGRAPHICS = COHORT + f""",
firsts AS (SELECT status, sub_id, {_first(['gender', *_MEANS])} FROM cohort GROUP BY 1, 2),
demo AS (SELECT status, count(*) AS n_subjects, count(*) FILTER (WHERE gender = 'male') AS n_male,
  count(*) FILTER (WHERE gender = 'female') AS n_female, """ + ", ".join(
    f"avg({c}) AS mean_{c}" for c in _MEANS) + """ FROM firsts GROUP BY 1),
totals AS (SELECT status, count(*) AS n_sessions FROM cohort GROUP BY 1)"""


@query("a02_demographics", f"WITH {DEMOGRAPHICS} SELECT status, n_subjects, n_male, n_female, n_sessions, " + ", ".join(
    f"round(mean_{c}, 6) AS mean_{c}" for c in _MEANS) + " FROM demo JOIN totals USING (status)")
def _(t):
    out = ops.demographics(cohort(t), "status", _MEANS)
    return out.select("status", "n_subjects", "n_male", "n_female", "n_sessions",
                      *[r6(F.col(f"mean_{c}")).alias(f"mean_{c}") for c in _MEANS])


_CELLS = ["n_male", "n_female", "n_sessions", "mean_age", "mean_height"]


@query("a03_cell_check", f"""WITH {DEMOGRAPHICS},
raw AS (SELECT status, sub_id, arg_min({_num('r.height')}, struct_pack(a := c.dated IS NULL,
          b := coalesce(c.dated, TIMESTAMP '1900-01-01'), c := c.filename)) FILTER (WHERE {_num('r.height')} IS NOT NULL) AS h
        FROM cohort c JOIN sessions r USING (sub_id, filename) GROUP BY 1, 2),
rawmean AS (SELECT status, avg(h) AS h FROM raw GROUP BY 1),
cells AS (SELECT d.*, t.n_sessions, m.h FROM demo d JOIN totals t USING (status) JOIN rawmean m USING (status)),
long AS (
  SELECT status, 'n_male' AS "column", n_male::DOUBLE AS observed, n_male::DOUBLE AS expected FROM cells
  UNION ALL SELECT status, 'n_female', n_female, n_female FROM cells
  UNION ALL SELECT status, 'n_sessions', n_sessions, n_sessions FROM cells
  UNION ALL SELECT status, 'mean_age', mean_age, mean_age FROM cells
  UNION ALL SELECT status, 'mean_height', mean_height, h FROM cells)
SELECT status, "column", round(observed, 6) AS observed, round(expected, 6) AS expected, abs(observed - expected) <= 0.01 AS matches FROM long""")
def _(t):
    """The masked table against one whose heights keep the sentinel: counts agree, height does not."""
    clean = cohort(t)
    raw = sessions(t).select("sub_id", "filename", tx.to_number(F.col("height")).alias("_h"))
    published = clean.join(raw, ["sub_id", "filename"]).withColumn("height", F.col("_h")).drop("_h")
    long = [ops.unpivot(ops.demographics(d, "status", ["age", "height"]), ["status"], _CELLS) for d in (clean, published)]
    out = ops.compare_cells(long[0], long[1], ["status"], ["n_male", "n_female", "n_sessions"])
    return out.select("status", "column", r6(F.col("observed")).alias("observed"), r6(F.col("expected")).alias("expected"), "matches")


_PROFILED = ["datestring", "injdefn", "age", "height", "years", "level"]


@query("a04_column_profile", f"WITH {SESSIONS} " + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", CASE WHEN count(*) FILTER (WHERE {_num(c)} IS NOT NULL) > 0.5 * (count(*) FILTER (WHERE {_norm(c)} NOT IN {_TOKENS}))
  THEN 'numeric' ELSE 'text' END AS kind, count(*) FILTER (WHERE {_norm(c)} IN {_TOKENS}) AS n_null, count(DISTINCT {c}) AS n_distinct,
  round((count(*) FILTER (WHERE {_norm(c)} IN {_TOKENS}))::DOUBLE / count(*), 6) AS null_rate FROM sessions""" for c in _PROFILED))
def _(t):
    return ops.profile(sessions(t), _PROFILED).withColumn("null_rate", r6(F.col("null_rate")))


@query("a05_offenders", f"WITH {SESSIONS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {_num(c)} AS value, count(*) AS n FROM sessions WHERE NOT ({_num(c)} BETWEEN {lo} AND {hi}) GROUP BY 2"""
    for c, (lo, hi) in tx.PLAUSIBLE.items()))
def _(t):
    return ops.offenders(sessions(t), tx.PLAUSIBLE)


@query("a06_wave_report", f"""WITH {COHORT}
SELECT wave, count(*) AS n, round(avg(label), 6) AS label_rate, round(avg(years_missing), 6) AS years_missing_rate,
  round(avg(level_missing), 6) AS level_missing_rate,
  round((count(*) FILTER (WHERE level_missing = 1 AND label = 0))::DOUBLE / nullif(count(*) FILTER (WHERE level_missing = 1), 0), 6) AS blank_level_precision
FROM cohort WHERE label IS NOT NULL AND injury <> 'osteoarthritis' GROUP BY 1""")
def _(t):
    kept = cohort(t).filter(F.col("label").isNotNull() & (F.col("injury") != "osteoarthritis"))
    out = ops.wave_report(kept)
    return out.select("wave", "n", *[r6(F.col(c)).alias(c) for c in out.columns[2:]])


@query("a07_top_diagnoses", f"""WITH {COHORT}
SELECT injury, count(*) AS sessions, count(DISTINCT sub_id) AS subjects FROM cohort
WHERE status = 'injured' AND injury NOT IN {_NO_INJURY} GROUP BY 1 ORDER BY sessions DESC, injury LIMIT 10""")
def _(t):
    injured = cohort(t).filter((F.col("status") == "injured") & ~F.col("injury").isin(tx.NO_INJURY_TOKENS))
    per = injured.groupBy("injury", "sub_id").agg(F.count(F.lit(1)).alias("n"))
    return (per.groupBy("injury").agg(F.sum("n").alias("sessions"), F.count(F.lit(1)).alias("subjects"))
            .orderBy(F.desc("sessions"), "injury").limit(10))


@query("a08_repeats", """SELECT sessions, count(*) AS subjects FROM (
  SELECT o_custkey, count(*) AS sessions FROM orders GROUP BY 1) GROUP BY 1""")
def _(t):
    return ops.repeats(t.orders, "o_custkey")


@query("a08_repeats_summary", """SELECT count(*) AS n_subjects, min(sessions) AS fewest, max(sessions) AS most,
  count(*) FILTER (WHERE sessions > 1) AS n_repeating, quantile_cont(sessions, 0.5) AS median FROM (
  SELECT o_custkey, count(*) AS sessions FROM orders GROUP BY 1)""")
def _(t):
    return ops.repeats_summary(t.orders, "o_custkey")


@query("a09_mixed_labels", f"""WITH {COHORT}
SELECT sub_id, filename, label FROM cohort WHERE label IS NOT NULL AND sub_id IN (
  SELECT sub_id FROM cohort GROUP BY 1 HAVING count(DISTINCT label) > 1)""")
def _(t):
    return ops.mixed_label_sessions(cohort(t).filter(F.col("label").isNotNull())).select("sub_id", "filename", "label")


@query("a10_cross_tab", """SELECT o_orderpriority,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS n_F, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_O,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS n_P,
  round((count(*) FILTER (WHERE o_orderstatus = 'F')) / count(*)::DOUBLE, 6) AS share_F,
  round((count(*) FILTER (WHERE o_orderstatus = 'O')) / count(*)::DOUBLE, 6) AS share_O,
  round((count(*) FILTER (WHERE o_orderstatus = 'P')) / count(*)::DOUBLE, 6) AS share_P FROM orders GROUP BY 1""")
def _(t):
    levels = ["F", "O", "P"]
    out = ops.cross_tab(t.orders, "o_orderpriority", "o_orderstatus", levels)
    return out.select("o_orderpriority", *[f"n_{v}" for v in levels], *[r6(F.col(f"share_{v}")).alias(f"share_{v}") for v in levels])


_STAGES = [("labelled", "label IS NOT NULL"), ("not osteoarthritis", "injury <> 'osteoarthritis'"),
           ("dated", "wave IS NOT NULL"), ("height known", "height IS NOT NULL"), ("since 1996", "wave >= 1996")]


@query("a43_funnel", f"WITH {COHORT} " + " UNION ALL ".join(
    f"SELECT {i + 1}::BIGINT AS step, '{name}' AS stage, count(*) AS n_rows, count(DISTINCT sub_id) AS n_subjects FROM cohort WHERE "
    + " AND ".join(f"({c})" for _, c in _STAGES[:i + 1]) for i, (name, _) in enumerate(_STAGES)))
def _(t):
    return ops.funnel(cohort(t), "sub_id", [(n, F.expr(c)) for n, c in _STAGES])


@query("a44_assignment_check", """WITH a AS (
  SELECT CAST('0x' || substr(md5(o_orderkey::VARCHAR || '|arm'), 1, 8) AS BIGINT) % 4 AS arm, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END AS y FROM orders)
SELECT arm, count(*) AS n, round(avg(y), 6) AS rate, round(abs(avg(y) - (SELECT avg(y) FROM a)), 6) AS deviation,
  abs(avg(y) - (SELECT avg(y) FROM a)) < 0.06 AS independent FROM a GROUP BY 1""")
def _(t):
    out = ops.assignment_check(t.orders, F.col("o_orderkey"), F.col("o_orderstatus") == "F", 4)
    return out.select("arm", "n", r6(F.col("rate")).alias("rate"), r6(F.col("deviation")).alias("deviation"), "independent")


@query("w01_first_session", f"""WITH {COHORT}
SELECT sub_id, {_first(['age', 'height', 'weight', 'gender', 'wave'])} FROM cohort GROUP BY 1""")
def _(t):
    return ops.first_known_per_group(cohort(t), ["sub_id"], ["dated", "filename"], ["age", "height", "weight", "gender", "wave"])


@query("w02_round_robin", f"""WITH {COHORT},
t AS (SELECT status || '/' || CASE WHEN status = 'injured' THEN injury ELSE '' END AS bucket, sub_id, filename,
      row_number() OVER (PARTITION BY status || '/' || CASE WHEN status = 'injured' THEN injury ELSE '' END ORDER BY sub_id, filename) AS turn FROM cohort)
SELECT bucket, sub_id, filename, turn FROM t ORDER BY turn, bucket LIMIT 20""")
def _(t):
    bucket = F.concat("status", F.lit("/"), F.when(F.col("status") == "injured", F.col("injury")).otherwise(""))
    rows = cohort(t).select(bucket.alias("bucket"), "sub_id", "filename")
    return ops.round_robin_sample(rows, "bucket", ["sub_id", "filename"], 20)


@query("j18_contained_name", """WITH names AS (SELECT DISTINCT p_brand AS trial FROM part),
others AS (SELECT DISTINCT 'Brand#' || CAST(l_suppkey % 1000 AS VARCHAR) AS clip FROM lineitem)
SELECT trial, min(clip) AS clip FROM names JOIN others ON contains(clip, trial) OR contains(trial, clip) GROUP BY 1""")
def _(t):
    clips = t.lineitem.select(F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 1000).cast("string")).alias("clip"))
    return joins.contained_name(t.part.select(F.col("p_brand").alias("trial")), clips, "trial", "clip")
