"""Evaluation and statistics queries: orders are scored rows, customers the subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin.functions.numeric import (
    REPLICATE_LIMITS, REPLICATE_MIX, REPLICATE_PRIME, portable_hash, r6)
from tempograin.operators import evaluation as ev
from tempograin.operators import joins
from tempograin.operators import statistics as st
from tempograin.plans.registry import query
from tempograin.sources.tables import Tables

REPLICATES = 2000

SCORE_COLUMNS = {
    "row_id": "o_orderkey",
    "subject": "o_custkey",
    "wave": "CAST(year(o_orderdate) AS INT)",
    "y": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
    "p": "(((o_orderkey * 37) % 800) + CASE WHEN o_orderstatus = 'F' THEN 100 ELSE 0 END + 50) / CAST(1000 AS DOUBLE)",
    "q": "(((o_orderkey * 53) % 800) + CASE WHEN o_orderstatus = 'F' THEN 60 ELSE 0 END + 70) / CAST(1000 AS DOUBLE)",
}


def scored(t: Tables) -> DataFrame:
    """(row_id, subject, wave, y, p, q): a label and two models' scores per order."""
    return t.orders.select(*[F.expr(e).alias(n) for n, e in SCORE_COLUMNS.items()])


def folds(t: Tables) -> DataFrame:
    return ev.assign_folds(scored(t), "subject", "y")


def fold_scores(t: Tables) -> DataFrame:
    """Every row once per seed, in the fold that tests its subject."""
    return scored(t).join(folds(t), "subject")


FOLD = ["seed", "fold"]

SCORED = "scored AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in SCORE_COLUMNS.items()) + " FROM orders)"


def _hash(*parts: str) -> str:
    text = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


FOLDS = SCORED + f""",
per AS (SELECT subject, count(*) AS n, sum(y) AS pos FROM scored GROUP BY 1),
strata AS (SELECT subject, seed, CASE WHEN pos = 0 THEN 0 WHEN pos = n THEN 2 ELSE 1 END AS mix, floor(log2(n)) AS size, {_hash('seed', 'subject')} AS h
           FROM per, (SELECT unnest([11, 23, 37, 53, 71]) AS seed)),
folds AS (SELECT seed, subject, CAST((row_number() OVER (PARTITION BY seed, mix, size ORDER BY h, subject) - 1) % 5 AS INTEGER) AS fold FROM strata)"""
FOLD_SCORES = FOLDS + ", fs AS (SELECT * FROM scored JOIN folds USING (subject))"


def _auc(source: str, keys: str, score: str, name: str) -> str:
    """CTE with the tie-averaged rank AUC per key."""
    part = f"PARTITION BY {keys}" if keys else ""
    head, group = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""{name}_r AS (SELECT {head}y, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER (PARTITION BY {head}{score}) - 1) / 2.0 AS rk FROM {source}),
{name} AS (SELECT {head}sum(y) AS n_pos, count(*) - sum(y) AS n_neg,
  (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM {name}_r {group})"""


@query("e01_group_folds", f"WITH {FOLDS} SELECT seed, subject, fold FROM folds")
def _(t):
    return folds(t)


@query("e02_leave_one_wave_out", f"""WITH {SCORED},
good AS (SELECT wave AS fold FROM scored GROUP BY 1 HAVING count(*) >= 20 AND min(y) <> max(y)),
gw AS (SELECT subject, wave, count(*) AS n FROM scored GROUP BY 1, 2),
te AS (SELECT fold, subject, wave, n, 'test' AS role FROM gw JOIN good ON wave = fold)
SELECT * FROM te UNION ALL
SELECT fold, subject, wave, n, 'train' FROM gw, good WHERE wave <> fold AND NOT EXISTS (SELECT 1 FROM te WHERE te.fold = good.fold AND te.subject = gw.subject)""")
def _(t):
    return ev.leave_one_wave_out(scored(t), "subject", "wave", "y")


@query("j17_leak_check", f"""WITH {FOLDS},
roles AS (SELECT seed, k AS fold, subject, CASE WHEN k = fold THEN 'test' ELSE 'train' END AS role FROM folds, (SELECT unnest(generate_series(0, 4))::INTEGER AS k))
SELECT seed, fold, count(*) FILTER (WHERE tr AND te) AS n_leaking, true AS clean FROM (
  SELECT seed, fold, subject, bool_or(role = 'train') AS tr, bool_or(role = 'test') AS te FROM roles GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def _(t):
    return joins.require_no_leak(ev.fold_roles(folds(t)), FOLD, "subject")


@query("e06_roc_auc", f"""WITH {FOLD_SCORES}, {_auc('fs', 'seed, fold', 'p', 'a')}
SELECT seed, fold, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(auc, 6) AS auc FROM a""")
def _(t):
    return ev.auc(fold_scores(t), FOLD, "y", "p").withColumn("auc", r6(F.col("auc")))


@query("e06_roc_auc_pooled", f"""WITH {SCORED}, {_auc('scored', '', 'p', 'a')}
SELECT n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(auc, 6) AS auc FROM a""")
def _(t):
    return ev.auc(scored(t), [], "y", "p").withColumn("auc", r6(F.col("auc")))


@query("e07_average_precision", f"""WITH {FOLD_SCORES},
c AS (SELECT seed, fold, p, sum(y) AS pos, count(*) AS n FROM fs GROUP BY 1, 2, 3),
w AS (SELECT *, sum(pos) OVER (PARTITION BY seed, fold ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY seed, fold ORDER BY p DESC) AS k,
        sum(pos) OVER (PARTITION BY seed, fold) AS np FROM c)
SELECT seed, fold, round(sum(pos::DOUBLE / np * (tp::DOUBLE / k)), 6) AS ap FROM w GROUP BY 1, 2""")
def _(t):
    return ev.average_precision(fold_scores(t), FOLD, "y", "p").withColumn("ap", r6(F.col("ap")))


@query("e08_fold_interval", f"""WITH {FOLD_SCORES}, {_auc('fs', 'seed, fold', 'p', 'a')}
SELECT count(auc) AS n, round(avg(auc), 6) AS mean, round(quantile_cont(auc, 0.025), 6) AS lo, round(quantile_cont(auc, 0.975), 6) AS hi FROM a""")
def _(t):
    out = ev.percentile_interval(ev.auc(fold_scores(t), FOLD, "y", "p"), [], "auc")
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("mean", "lo", "hi")])


@query("e09_paired_fold_delta", f"""WITH {FOLD_SCORES}, {_auc('fs', 'seed, fold', 'p', 'a')}, {_auc('fs', 'seed, fold', 'q', 'b')},
d AS (SELECT a.auc - b.auc AS d FROM a JOIN b USING (seed, fold))
SELECT count(*) AS n, round(avg(d), 6) + 0.0 AS delta, count(*) FILTER (WHERE d > 0) AS wins, round(quantile_cont(d, 0.025), 6) + 0.0 AS lo,
  round(quantile_cont(d, 0.975), 6) + 0.0 AS hi, quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS excludes_zero FROM d""")
def _(t):
    fs = fold_scores(t)
    out = ev.paired_fold_delta(ev.auc(fs, FOLD, "y", "p"), ev.auc(fs, FOLD, "y", "q"), FOLD, "auc")
    return out.select("n", "wins", "excludes_zero", *[r6(F.col(c)).alias(c) for c in ("delta", "lo", "hi")])


@query("e10_out_of_fold", f"""WITH {FOLD_SCORES}
SELECT row_id, round(avg(p + fold / 100.0), 6) AS oof, count(*) AS n FROM fs GROUP BY 1""")
def _(t):
    fs = fold_scores(t).withColumn("s", F.col("p") + F.col("fold") / 100.0)
    return ev.out_of_fold(fs, "row_id", "s", scored(t)).withColumn("oof", r6(F.col("oof")))


def _draws(source: str, keys: str, subject: str, reps: int, seed: int, name: str) -> str:
    """CTE (keys, rep, subject, w) replaying the replicates' counts."""
    head = f"{keys}, " if keys else ""
    first, second = REPLICATE_MIX
    counts = " ".join(f"WHEN x <= {limit} THEN {k}" for k, limit in enumerate(REPLICATE_LIMITS))
    parts = [str(seed), *([keys] if keys else []), subject]
    return f"""{name}_x AS (SELECT DISTINCT {head}{subject}, {_hash(*parts)} % {REPLICATE_PRIME} AS x FROM {source}),
{name}_1 AS (SELECT {head}rep, {subject}, x * (2 * rep + 1) % {REPLICATE_PRIME} AS x FROM {name}_x, (SELECT unnest(generate_series(1, {reps})) AS rep)),
{name}_2 AS (SELECT {head}rep, {subject}, xor(x, x >> 15) * {first} % {REPLICATE_PRIME} AS x FROM {name}_1),
{name}_3 AS (SELECT {head}rep, {subject}, xor(x, x >> 13) * {second} % {REPLICATE_PRIME} AS x FROM {name}_2),
{name} AS (SELECT * FROM (SELECT {head}rep, {subject}, CASE {counts} ELSE {len(REPLICATE_LIMITS)} END AS w FROM {name}_3) WHERE w > 0)"""


PER_SUBJECT = """persub AS (SELECT c_mktsegment AS arm, o_custkey AS subject, avg(o_totalprice / 1000) AS v, avg(o_orderkey % 97) AS x
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def per_subject(t: Tables) -> DataFrame:
    return (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("c_mktsegment").alias("arm"), F.col("o_custkey").alias("subject"))
            .agg(F.avg(F.col("o_totalprice") / 1000).alias("v"), F.avg(F.col("o_orderkey") % 97).alias("x")))


@query("e11_subject_bootstrap", f"""WITH {PER_SUBJECT}, {_draws('persub', 'arm', 'subject', REPLICATES, 11, 'dr')},
m AS (SELECT arm, rep, sum(w * v) / sum(w) AS m FROM dr JOIN persub USING (arm, subject) GROUP BY 1, 2),
ci AS (SELECT arm, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY 1)
SELECT p.arm, count(*) AS n_subjects, round(avg(v), 5) AS mean, round(max(lo), 5) AS lo, round(max(hi), 5) AS hi
FROM persub p LEFT JOIN ci USING (arm) GROUP BY 1""")
def _(t):
    out = ev.bootstrap_mean(per_subject(t), ["arm"], "subject", "v", REPLICATES, 11)
    return out.select("arm", "n_subjects", *[F.round(c, 5).alias(c) for c in ("mean", "lo", "hi")])


@query("e12_bootstrap_auc", f"""WITH {SCORED}, {_draws('scored', '', 'subject', REPLICATES, 31, 'dr')},
c AS (SELECT rep, p, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg FROM dr JOIN scored USING (subject) GROUP BY 1, 2),
r AS (SELECT rep, pos, neg, sum(neg) OVER (PARTITION BY rep ORDER BY p) - neg AS below FROM c),
a AS (SELECT rep, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM r GROUP BY 1)
SELECT count(auc) AS n_kept, CASE WHEN count(auc) >= 100 THEN round(quantile_cont(auc, 0.025), 6) END AS lo,
  CASE WHEN count(auc) >= 100 THEN round(quantile_cont(auc, 0.975), 6) END AS hi FROM a""")
def _(t):
    out = ev.bootstrap_auc(scored(t), "subject", "y", "p", REPLICATES, 31)
    return out.select("n_kept", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))


@query("e13_bootstrap_spearman", f"""WITH {PER_SUBJECT}, {_draws('persub', '', 'subject', REPLICATES, 5, 'dr')},
j AS (SELECT rep, w, v, x FROM dr JOIN persub USING (subject)),
rx AS (SELECT rep, x, sum(sum(w)) OVER (PARTITION BY rep ORDER BY x) - (sum(w) - 1) / 2.0 AS rk FROM j GROUP BY 1, 2),
rv AS (SELECT rep, v, sum(sum(w)) OVER (PARTITION BY rep ORDER BY v) - (sum(w) - 1) / 2.0 AS rk FROM j GROUP BY 1, 2),
k AS (SELECT j.rep, w, rx.rk AS a, rv.rk AS b FROM j JOIN rx ON rx.rep = j.rep AND rx.x = j.x JOIN rv ON rv.rep = j.rep AND rv.v = j.v),
mm AS (SELECT rep, sum(w) AS n, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb FROM k GROUP BY 1),
rho AS (SELECT k.rep, sum(w * (a - ma) * (b - mb)) / sqrt(sum(w * (a - ma) * (a - ma)) * sum(w * (b - mb) * (b - mb))) AS rho FROM k JOIN mm USING (rep) GROUP BY 1),
pr AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS b FROM persub)
SELECT count(*) AS n, round(corr(a, b), 6) + 0.0 AS rho, (SELECT round(quantile_cont(rho, 0.025), 6) FROM rho) + 0.0 AS lo,
  (SELECT round(quantile_cont(rho, 0.975), 6) FROM rho) + 0.0 AS hi FROM pr""")
def _(t):
    out = st.bootstrap_spearman(per_subject(t), "subject", "x", "v", REPLICATES, 5)
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("rho", "lo", "hi")])


@query("e13_bootstrap_slope", f"""WITH {PER_SUBJECT}, {_draws('persub', '', 'subject', REPLICATES, 6, 'dr')},
j AS (SELECT rep, w, v, x FROM dr JOIN persub USING (subject)),
mm AS (SELECT rep, sum(w * x) / sum(w) AS mx, sum(w * v) / sum(w) AS mv FROM j GROUP BY 1),
s AS (SELECT j.rep, sum(w * (x - mx) * (v - mv)) / sum(w * (x - mx) * (x - mx)) AS s FROM j JOIN mm USING (rep) GROUP BY 1)
SELECT count(*) AS n, round(regr_slope(v, x), 6) + 0.0 AS slope, (SELECT round(quantile_cont(s, 0.025), 6) FROM s) + 0.0 AS lo,
  (SELECT round(quantile_cont(s, 0.975), 6) FROM s) + 0.0 AS hi FROM persub""")
def _(t):
    out = st.bootstrap_slope(per_subject(t), "subject", "x", "v", REPLICATES, 6)
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("slope", "lo", "hi")])


@query("e13_unpaired_difference", f"""WITH {PER_SUBJECT}, {_draws('persub', 'arm', 'subject', REPLICATES, 7, 'dr')},
m AS (SELECT arm, rep, sum(w * v) / sum(w) AS m FROM dr JOIN persub USING (arm, subject) GROUP BY 1, 2),
d AS (SELECT rep, max(m) FILTER (WHERE arm = 'MACHINERY') - max(m) FILTER (WHERE arm = 'BUILDING') AS d FROM m GROUP BY 1)
SELECT round(avg(v) FILTER (WHERE arm = 'MACHINERY') - avg(v) FILTER (WHERE arm = 'BUILDING'), 5) + 0.0 AS difference,
  (SELECT round(quantile_cont(d, 0.025), 5) FROM d) + 0.0 AS lo, (SELECT round(quantile_cont(d, 0.975), 5) FROM d) + 0.0 AS hi FROM persub""")
def _(t):
    out = ev.unpaired_difference(per_subject(t), "arm", "BUILDING", "MACHINERY", "subject", "v", REPLICATES, 7)
    return out.select(*[(F.round(c, 5) + 0.0).alias(c) for c in ("difference", "lo", "hi")])


@query("e14_operating_points", f"""WITH {SCORED},
c AS (SELECT p, sum(y) AS pos, count(*) - sum(y) AS neg FROM scored GROUP BY 1),
tot AS (SELECT sum(pos)::DOUBLE AS np, sum(neg)::DOUBLE AS nn FROM c),
cv AS (SELECT p AS threshold, sum(pos) OVER (ORDER BY p DESC) / np AS se, 1 - sum(neg) OVER (ORDER BY p DESC) / nn AS sp, np / (np + nn) AS prev FROM c, tot
       UNION ALL SELECT NULL, 0.0, 1.0, np / (np + nn) FROM tot),
rk AS (SELECT *, row_number() OVER (ORDER BY round(se + sp - 1, 9) DESC, coalesce(threshold, 'inf'::DOUBLE) DESC) AS a,
  row_number() OVER (ORDER BY round(abs(sp - 0.9), 9), coalesce(threshold, 'inf'::DOUBLE) DESC) AS b,
  row_number() OVER (ORDER BY round(abs(se - 0.9), 9), coalesce(threshold, 'inf'::DOUBLE) DESC) AS c,
  row_number() OVER (ORDER BY CASE WHEN threshold IS NULL THEN 1 ELSE 0 END, round(abs(threshold - 0.5), 9), threshold DESC) AS d FROM cv),
pk AS (SELECT 'youden' AS point, * FROM rk WHERE a = 1 UNION ALL SELECT 'specificity 0.90', * FROM rk WHERE b = 1
  UNION ALL SELECT 'sensitivity 0.90', * FROM rk WHERE c = 1 UNION ALL SELECT 'threshold 0.50', * FROM rk WHERE d = 1)
SELECT point, threshold, round(se, 6) AS sensitivity, round(sp, 6) AS specificity,
  round(se * prev / greatest(se * prev + (1 - sp) * (1 - prev), 1e-9), 6) AS ppv,
  round(sp * (1 - prev) / greatest(sp * (1 - prev) + (1 - se) * prev, 1e-9), 6) AS npv, round((se + sp) / 2, 6) AS balanced_accuracy FROM pk""")
def _(t):
    out = ev.operating_points(scored(t), [], "y", "p")
    return out.select("point", "threshold", *[r6(F.col(c)).alias(c) for c in (
        "sensitivity", "specificity", "ppv", "npv", "balanced_accuracy")])


@query("e15_brier", f"""WITH {SCORED}
SELECT count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(y) * (1 - avg(y)), 6) AS brier_baseline FROM scored""")
def _(t):
    out = ev.brier(scored(t), "y", "p")
    return out.select("n", r6(F.col("brier")).alias("brier"), r6(F.col("brier_baseline")).alias("brier_baseline"))


@query("e15_reliability_bins", f"""WITH {SCORED},
e AS (SELECT quantile_cont(p, 0.2) AS a, quantile_cont(p, 0.4) AS b, quantile_cont(p, 0.6) AS c, quantile_cont(p, 0.8) AS d FROM scored)
SELECT CASE WHEN p < a THEN 0 WHEN p < b THEN 1 WHEN p < c THEN 2 WHEN p < d THEN 3 ELSE 4 END AS bin, count(*) AS n,
  round(avg(p), 6) AS mean_pred, round(avg(y), 6) AS observed FROM scored, e GROUP BY 1""")
def _(t):
    out = ev.reliability_bins(scored(t), "y", "p")
    return out.select("bin", "n", r6(F.col("mean_pred")).alias("mean_pred"), r6(F.col("observed")).alias("observed"))


SAME = SCORED + """,
same AS (SELECT subject FROM scored GROUP BY 1 HAVING count(*) >= 2 AND min(y) = max(y)),
pairs AS (SELECT a.subject, a.p AS p1, b.p AS p2 FROM scored a JOIN scored b ON a.subject = b.subject AND a.row_id < b.row_id
          WHERE a.subject IN (SELECT subject FROM same))"""


@query("j10_repeat_pairs", f"""WITH {SAME}
SELECT subject, count(*) AS n_pairs, count(*) FILTER (WHERE (p1 > 0.5) = (p2 > 0.5)) AS n_agree, round(sum(abs(p1 - p2)), 6) + 0.0 AS sum_abs_diff FROM pairs GROUP BY 1""")
def _(t):
    out = ev.repeat_agreement(scored(t), "subject", "y", "p", "row_id")
    return out.select("subject", "n_pairs", "n_agree", r6(F.col("sum_abs_diff")).alias("sum_abs_diff"))


@query("e16_repeat_agreement", f"""WITH {SAME}
SELECT (SELECT count(*) FROM (SELECT subject FROM scored GROUP BY 1 HAVING count(*) >= 2)) AS n_subjects_multi_session,
  (SELECT count(*) FROM same) AS n_subjects_same_side, count(*) AS n_session_pairs, round(avg(CASE WHEN (p1 > 0.5) = (p2 > 0.5) THEN 1.0 ELSE 0 END), 6) AS binary_agreement,
  CASE WHEN count(*) > 2 THEN round(corr(p1, p2), 6) END + 0.0 AS score_corr, round(avg(abs(p1 - p2)), 6) AS mean_abs_score_diff FROM pairs""")
def _(t):
    s = scored(t)
    out = ev.repeat_summary(ev.repeat_agreement(s, "subject", "y", "p", "row_id"), s, "subject")
    return out.select("n_subjects_multi_session", "n_subjects_same_side", "n_session_pairs", *[
        r6(F.col(c)).alias(c) for c in ("binary_agreement", "score_corr", "mean_abs_score_diff")])


# The coverage levels of the protocol.
COVERAGES = [1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]
KEPT = FOLD_SCORES + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY seed, fold ORDER BY round(abs(p - 0.5), 9) DESC, row_id) - 1 AS i, count(*) OVER (PARTITION BY seed, fold) AS n FROM fs),
kept AS (SELECT *, coverage FROM rk, (SELECT unnest([1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]::DOUBLE[]) AS coverage) WHERE i < greatest(2, round_even(round(coverage * n, 6), 0)))"""


@query("w22_most_confident", f"""WITH {KEPT} SELECT seed, fold, coverage, row_id FROM kept""")
def _(t):
    return ev.most_confident(fold_scores(t), FOLD, "p", "row_id", COVERAGES).select("seed", "fold", "coverage", "row_id")


@query("e17_selective_curve", f"""WITH {KEPT}, {_auc('kept', 'seed, fold, coverage', 'p', 'a')},
pf AS (SELECT seed, fold, coverage, count(*) AS n, sum(y) AS pos, avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0 END) AS acc,
  (avg(CASE WHEN y = 1 THEN CASE WHEN p > 0.5 THEN 1.0 ELSE 0 END END) + avg(CASE WHEN y = 0 THEN CASE WHEN p > 0.5 THEN 0.0 ELSE 1 END END)) / 2 AS bal FROM kept GROUP BY 1, 2, 3)
SELECT coverage, round(avg(n), 6) AS mean_kept, round(avg(acc), 6) AS accuracy, round(avg(bal), 6) AS balanced_accuracy, round(avg(auc), 6) AS auc_on_kept,
  round(sum(pos) / sum(n), 6) AS base_rate FROM pf JOIN a USING (seed, fold, coverage) GROUP BY 1""")
def _(t):
    out = ev.selective_curve(fold_scores(t), FOLD, "y", "p", "row_id", COVERAGES)
    return out.select("coverage", *[r6(F.col(c)).alias(c) for c in out.columns[1:]])


@query("e18_averaging_gain", f"""WITH {SCORED},
per AS (SELECT subject, count(*) AS n, min(y) AS y, avg(p) AS p, count(*) FILTER (WHERE (p > 0.5) = (y = 1)) AS ok FROM scored GROUP BY 1 HAVING count(*) >= 2 AND min(y) = max(y))
SELECT count(*) AS n_subjects, sum(n)::BIGINT AS n_rows, round(sum(ok) / sum(n), 6) AS single_accuracy,
  round(avg(CASE WHEN (round(p, 9) > 0.5) = (y = 1) THEN 1.0 ELSE 0 END), 6) AS averaged_accuracy,
  round(avg(CASE WHEN (round(p, 9) > 0.5) = (y = 1) THEN 1.0 ELSE 0 END) - sum(ok) / sum(n), 6) + 0.0 AS gain FROM per""")
def _(t):
    out = ev.averaging_gain(scored(t), "subject", "y", "p")
    return out.select("n_subjects", "n_rows", *[r6(F.col(c)).alias(c) for c in ("single_accuracy", "averaged_accuracy", "gain")])


CONTROLS = {"wave": "wave", "subject": "subject % 89", "row": "row_id % 101"}


@query("e21_control_gate", f"WITH {SCORED}, " + ", ".join(
    f"s_{n} AS (SELECT y, ({e})::DOUBLE AS s FROM scored), {_auc(f's_{n}', '', 's', f'a_{n}')}" for n, e in CONTROLS.items()) +
    ", al AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, auc FROM a_{n}" for n in CONTROLS) +
    ") SELECT name AS worst, round(abs(auc - 0.5), 6) AS deviation, abs(auc - 0.5) < 0.08 AS passed FROM al ORDER BY round(abs(auc - 0.5), 9) DESC LIMIT 1")
def _(t):
    long = scored(t).select("y", F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.expr(e).cast("double").alias("s")) for n, e in CONTROLS.items()])).alias("c")
    ).select("y", "c.name", "c.s")
    out = ev.control_gate(ev.auc(long, ["name"], "y", "s"), 0.08)
    return out.withColumn("deviation", r6(F.col("deviation")))


TESTS = """tests AS (SELECT l_suppkey AS name, avg(l_discount) - 0.05 AS delta, (l_suppkey * 7919 % 1000 + 1) / CAST(20000 AS DOUBLE) * (1 + l_suppkey % 13) AS p
  FROM lineitem GROUP BY l_suppkey)"""


def tests(t: Tables) -> DataFrame:
    """One effect and p value per supplier."""
    return t.lineitem.groupBy(F.col("l_suppkey").alias("name")).agg((F.avg("l_discount") - 0.05).alias("delta")).withColumn(
        "p", F.expr("(name * 7919 % 1000 + 1) / CAST(20000 AS DOUBLE) * (1 + name % 13)"))


@query("e22_benjamini_hochberg", f"""WITH {TESTS},
r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM tests),
a AS (SELECT *, least(1.0, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_bh FROM r)
SELECT name, round(p, 6) AS p, round(p_bh, 6) AS p_bh, p_bh < 0.05 AND delta > 0 AS significant FROM a""")
def _(t):
    out = st.benjamini_hochberg(tests(t), "p", "name", "delta")
    return out.select("name", r6(F.col("p")).alias("p"), r6(F.col("p_bh")).alias("p_bh"), "significant")


@query("e23_holm", f"""WITH {TESTS},
r AS (SELECT *, row_number() OVER (ORDER BY p, name) - 1 AS i, count(*) OVER () AS m FROM tests),
a AS (SELECT *, least(1.0, max((m - i) * p) OVER (ORDER BY i)) AS p_holm FROM r)
SELECT name, round(p, 6) AS p, round(p_holm, 6) AS p_holm, p_holm < 0.05 AS reject FROM a""")
def _(t):
    out = st.holm(tests(t), "p", "name")
    return out.select("name", r6(F.col("p")).alias("p"), r6(F.col("p_holm")).alias("p_holm"), "reject")


@query("e24_wilcoxon", """WITH d AS (SELECT l_suppkey % 20 AS grp, round(l_discount - l_tax, 6) AS d FROM lineitem),
nz AS (SELECT grp, d, round(abs(d), 12) AS a FROM d WHERE d <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY grp ORDER BY a) + (count(*) OVER (PARTITION BY grp, a) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY grp, a) AS t FROM nz),
s AS (SELECT grp, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w_plus, sum(t::DOUBLE * t - 1) AS tie FROM r GROUP BY 1)
SELECT grp, n, w_plus, round((w_plus - n * (n + 1) / 4.0) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - tie / 48), 6) + 0.0 AS z FROM s""")
def _(t):
    deltas = t.lineitem.select((F.col("l_suppkey") % 20).alias("grp"), F.round(F.col("l_discount") - F.col("l_tax"), 6).alias("d"))
    return st.wilcoxon(deltas, ["grp"], "d").select("grp", "n", "w_plus", r6(F.col("z")).alias("z"))


@query("e24_wilcoxon_folds", f"""WITH {FOLD_SCORES}, {_auc('fs', 'seed, fold', 'p', 'a')}, {_auc('fs', 'seed, fold', 'q', 'b')},
d AS (SELECT seed, a.auc - b.auc AS d FROM a JOIN b USING (seed, fold)),
r AS (SELECT *, rank() OVER (PARTITION BY seed ORDER BY round(abs(d), 12)) + (count(*) OVER (PARTITION BY seed, round(abs(d), 12)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY seed, round(abs(d), 12)) AS t FROM d WHERE d <> 0),
s AS (SELECT seed, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w_plus, sum(t::DOUBLE * t - 1) AS tie FROM r GROUP BY 1),
z AS (SELECT *, (w_plus - n * (n + 1) / 4.0) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24 - tie / 48) AS z FROM s)
SELECT seed, n, w_plus, round(z, 6) + 0.0 AS z, round(CASE WHEN tie = 0 AND n = total AND n <= 20 THEN least(1.0, 2 * least(
  (SELECT count(*) FROM generate_series(0, (1 << n) - 1) AS m(m) WHERE list_sum(list_transform(generate_series(1, n), lambda j: ((m >> (j - 1)) & 1) * j)) <= w_plus),
  (SELECT count(*) FROM generate_series(0, (1 << n) - 1) AS m(m) WHERE list_sum(list_transform(generate_series(1, n), lambda j: ((m >> (j - 1)) & 1) * j)) >= w_plus)) / power(2.0, n))
  ELSE least(1.0, 2 * (0.5 - exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(generate_series(0, 60), lambda k:
  power(abs(z), 2 * k + 1) / list_product(list_concat([1.0::DOUBLE], list_transform(generate_series(1, k), lambda j: (2 * j + 1)::DOUBLE))))))) END, 6) AS p FROM z JOIN (SELECT seed, count(*) AS total FROM d GROUP BY 1) USING (seed)""")
def _(t):
    fs = fold_scores(t)
    a, b = (ev.auc(fs, FOLD, "y", c).select(*FOLD, F.col("auc").alias(c)) for c in ("p", "q"))
    out = st.wilcoxon(a.join(b, FOLD).select("seed", (F.col("p") - F.col("q")).alias("d")), ["seed"], "d")
    return out.select("seed", "n", "w_plus", r6(F.col("z")).alias("z"), r6(F.col("p")).alias("p"))


_DF = 24


@query("e25_fold_t", f"""WITH {FOLD_SCORES}, {_auc('fs', 'seed, fold', 'p', 'a')},
s AS (SELECT count(*) AS n, avg(auc) AS mean, (avg(auc) - 0.5) / (stddev_samp(auc) / sqrt(25)) AS t FROM a),
th AS (SELECT *, atan(t / sqrt({_DF})) AS th FROM s)
SELECT n, round(mean, 6) AS mean, round(t, 6) AS t, round(0.5 - sin(th) * list_sum(list_transform(generate_series(0, {_DF // 2 - 1}), lambda k:
  list_product(list_concat([1.0::DOUBLE], list_transform(generate_series(1, k), lambda j: cos(th) * cos(th) * (2.0 * j - 1) / (2.0 * j)))))) / 2, 6) + 0.0 AS p FROM th""")
def _(t):
    out = st.fold_t(ev.auc(fold_scores(t), FOLD, "y", "p"), "auc", 25)
    return out.select("n", r6(F.col("mean")).alias("mean"), r6(F.col("t")).alias("t"), r6(F.col("p")).alias("p"))


@query("e26_spearman", """WITH r AS (SELECT l_suppkey % 50 AS grp,
  rank() OVER (PARTITION BY l_suppkey % 50 ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey % 50, l_quantity) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY l_suppkey % 50 ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey % 50, l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT grp, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1 HAVING count(*) >= 50""")
def _(t):
    rows = t.lineitem.select((F.col("l_suppkey") % 50).alias("grp"), "l_quantity", "l_extendedprice")
    return st.spearman(rows, ["grp"], "l_quantity", "l_extendedprice", 50).withColumn("rho", r6(F.col("rho")))


@query("e26_mean_spearman", """WITH r AS (SELECT l_suppkey % 50 AS grp,
  rank() OVER (PARTITION BY l_suppkey % 50 ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey % 50, l_quantity) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY l_suppkey % 50 ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey % 50, l_extendedprice) - 1) / 2.0 AS b FROM lineitem),
g AS (SELECT grp, corr(a, b) AS rho FROM r GROUP BY 1 HAVING count(*) >= 50)
SELECT count(*) AS n_subjects, round(avg(rho), 6) AS mean_rho, round(min(rho), 6) AS min_rho FROM g""")
def _(t):
    rows = t.lineitem.select((F.col("l_suppkey") % 50).alias("grp"), "l_quantity", "l_extendedprice")
    per = st.spearman(rows, ["grp"], "l_quantity", "l_extendedprice", 50)
    return per.agg(F.count(F.lit(1)).alias("n_subjects"), r6(F.avg("rho")).alias("mean_rho"), r6(F.min("rho")).alias("min_rho"))


_RESID = """g AS (SELECT l_quantity AS x1, l_tax * 100 AS x2, l_extendedprice / 1000 AS y, l_discount * 100 + l_linenumber AS z FROM lineitem),
a AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, avg(z) AS mz, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12,
  covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y, covar_pop(x1, z) AS s1z, covar_pop(x2, z) AS s2z FROM g)"""


@query("e27_partial_spearman", f"""WITH {_RESID},
b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2,
  (s1z * s22 - s2z * s12) / (s11 * s22 - s12 * s12) AS c1, (s2z * s11 - s1z * s12) / (s11 * s22 - s12 * s12) AS c2 FROM a),
e AS (SELECT round(y - my - b1 * (x1 - m1) - b2 * (x2 - m2), 7) AS ry, round(z - mz - c1 * (x1 - m1) - c2 * (x2 - m2), 7) AS rz FROM g, b),
r AS (SELECT rank() OVER (ORDER BY ry) + (count(*) OVER (PARTITION BY ry) - 1) / 2.0 AS p, rank() OVER (ORDER BY rz) + (count(*) OVER (PARTITION BY rz) - 1) / 2.0 AS q FROM e)
SELECT count(*) AS n, round(corr(p, q), 4) + 0.0 AS rho FROM r""")
def _(t):
    rows = t.lineitem.select(F.col("l_quantity").alias("x1"), (F.col("l_tax") * 100).alias("x2"), (F.col("l_extendedprice") / 1000).alias("y"),
                             (F.col("l_discount") * 100 + F.col("l_linenumber")).alias("z"))
    left = st.residualise(rows, ["x1", "x2"], ["y", "z"])
    ranked = left.select(F.round("y_resid", 7).alias("ry"), F.round("z_resid", 7).alias("rz"))
    return st.spearman(ranked, [], "ry", "rz").withColumn("rho", F.round("rho", 4) + 0.0)


@query("e28_simple_ols", """SELECT l_returnflag AS grp, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
  round(avg(abs(l_extendedprice - l_quantity)), 4) AS mean_abs_gap FROM lineitem GROUP BY 1
UNION ALL SELECT 'all', count(*), round(regr_slope(l_extendedprice, l_quantity), 4), round(regr_intercept(l_extendedprice, l_quantity), 4),
  round(regr_r2(l_extendedprice, l_quantity), 6), round(avg(abs(l_extendedprice - l_quantity)), 4) FROM lineitem""")
def _(t):
    per = st.ols(t.lineitem.withColumn("grp", F.col("l_returnflag")), ["grp"], "l_quantity", "l_extendedprice")
    whole = st.ols(t.lineitem, [], "l_quantity", "l_extendedprice").withColumn("grp", F.lit("all"))
    both = per.unionByName(whole)
    return both.select("grp", "n", *[F.round(c, 4).alias(c) for c in ("slope", "intercept", "mean_abs_gap")], r6(F.col("r2")).alias("r2"))


@query("e29_multiple_ols", f"""WITH {_RESID},
b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM a),
e AS (SELECT count(*) AS n, sum(power(y - my - b1 * (x1 - m1) - b2 * (x2 - m2), 2)) AS sse, sum(power(y - my, 2)) AS sst FROM g, b),
s AS (SELECT b.*, e.*, sse / (n - 3) AS s2, (s11 * s22 - s12 * s12) * n AS det FROM b, e),
v AS (SELECT *, sqrt(s2 * s22 / det) AS e1, sqrt(s2 * s11 / det) AS e2, my - b1 * m1 - b2 * m2 AS b0,
  sqrt(s2 * (1.0 / n + (m1 * m1 * s22 + m2 * m2 * s11 - 2 * m1 * m2 * s12) / det)) AS e0 FROM s)
SELECT 'intercept' AS term, n, round(b0, 5) AS slope, round(b0 - 1.96 * e0, 5) AS lo, round(b0 + 1.96 * e0, 5) AS hi, round(1 - sse / sst, 6) AS r2 FROM v
UNION ALL SELECT 'x1', n, round(b1, 5), round(b1 - 1.96 * e1, 5), round(b1 + 1.96 * e1, 5), round(1 - sse / sst, 6) FROM v
UNION ALL SELECT 'x2', n, round(b2, 5), round(b2 - 1.96 * e2, 5), round(b2 + 1.96 * e2, 5), round(1 - sse / sst, 6) FROM v""")
def _(t):
    rows = t.lineitem.select(F.col("l_quantity").alias("x1"), (F.col("l_tax") * 100).alias("x2"), (F.col("l_extendedprice") / 1000).alias("y"))
    out = st.multiple_ols(rows, ["x1", "x2"], "y")
    return out.select("term", "n", *[(F.round(c, 5) + 0.0).alias(c) for c in ("slope", "lo", "hi")], r6(F.col("r2")).alias("r2"))


def error_rows(t: Tables) -> DataFrame:
    """(subject, fold, features, log error) per lineitem; the supplier is the subject."""
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("subject"), (F.col("l_suppkey") % 5).alias("fold"),
        F.col("l_quantity").alias("f1"), (F.col("l_discount") * 10).alias("f2"), F.log(F.col("l_extendedprice") / 1000 + 0.05).alias("log_error"))


_GRAM = {"n": "1", "a": "f1", "b": "f2", "y": "le", "aa": "f1 * f1", "ab": "f1 * f2", "bb": "f2 * f2", "fy": "f1 * le", "gy": "f2 * le", "yy": "le * le"}


def _ridge_fit(source: str, out: str, keys: str) -> str:
    """Ridge on standardised features from Gram sums: slopes and intercept on the raw scale."""
    return f"""{out}_s AS (SELECT *, a / n AS ma, b / n AS mb, y / n AS my, sqrt(aa / n - (a / n) * (a / n)) AS sa, sqrt(bb / n - (b / n) * (b / n)) AS sb FROM {source}),
{out}_c AS (SELECT *, n * (ab / n - ma * mb) / (sa * sb) AS r, n * (fy / n - ma * my) / sa AS ca, n * (gy / n - mb * my) / sb AS cb FROM {out}_s),
{out}_z AS (SELECT *, ((n + alpha) * ca - r * cb) / ((n + alpha) * (n + alpha) - r * r) AS za, ((n + alpha) * cb - r * ca) / ((n + alpha) * (n + alpha) - r * r) AS zb FROM {out}_c),
{out} AS (SELECT {keys}, za / sa AS ba, zb / sb AS bb1, my - za / sa * ma - zb / sb * mb AS b0 FROM {out}_z)"""


_SUMS = ", ".join(f"sum({e}) AS {n}" for n, e in _GRAM.items())
_TRAIN = ", ".join(f"t.{n} - h.{n} AS {n}" for n in _GRAM)


@query("e30_ridge_smearing", f"""WITH rw AS (SELECT l_orderkey, l_linenumber, l_suppkey % 5 AS fold, l_quantity AS f1, l_discount * 10 AS f2, ln(l_extendedprice / 1000 + 0.05::DOUBLE) AS le FROM lineitem),
gr AS (SELECT fold, {_SUMS} FROM rw GROUP BY 1), tt AS (SELECT {_SUMS} FROM rw),
al AS (SELECT power(10.0::DOUBLE, e / 2.0) AS alpha FROM (SELECT unnest(generate_series(-6, 6)) AS e)),
tr AS (SELECT h.fold AS held, alpha, {_TRAIN} FROM tt t, gr h, al), {_ridge_fit('tr', 'fit', 'held, alpha, n, ma, mb, sa, sb, r')},
loo AS (SELECT held, alpha, le - (b0 + ba * f1 + bb1 * f2) AS e, 1 - 1.0 / n - ((n + alpha) * (za * za + zb * zb) - 2 * r * za * zb) / ((n + alpha) * (n + alpha) - r * r) AS rest
  FROM (SELECT *, (f1 - ma) / sa AS za, (f2 - mb) / sb AS zb FROM rw JOIN fit ON rw.fold <> fit.held)),
cost AS (SELECT held, alpha, avg((e / rest) * (e / rest)) AS c FROM loo GROUP BY 1, 2),
pick AS (SELECT held, arg_min(alpha, struct_pack(c := c, a := alpha)) AS alpha FROM cost GROUP BY 1),
ob AS (SELECT fit.* FROM fit JOIN pick USING (held, alpha)),
sm AS (SELECT held, avg(exp(le - (b0 + ba * f1 + bb1 * f2))) AS s FROM rw JOIN ob ON rw.fold <> ob.held GROUP BY 1)
SELECT l_orderkey, l_linenumber, fold, round(exp(b0 + ba * f1 + bb1 * f2) * s, 4) + 0.0 AS stated FROM rw JOIN ob ON ob.held = rw.fold JOIN sm ON sm.held = rw.fold""")
def _(t):
    rows = error_rows(t)
    out = st.ridge_out_of_fold(rows, "fold", ["f1", "f2"], "log_error", [10.0 ** (e / 2) for e in range(-6, 7)])
    return out.select("l_orderkey", "l_linenumber", "fold", (F.round(F.exp("oof"), 4) + 0.0).alias("stated"))


@query("e31_permutation_control", f"""WITH c AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
  row_number() OVER (PARTITION BY user_id ORDER BY {_hash('11', 'event_id')}, event_id) AS j FROM events)
SELECT a.user_id, a.event_id, round(b.value, 6) AS shuffled FROM c a JOIN c b ON a.user_id = b.user_id AND a.i = b.j""")
def _(t):
    out = st.shuffle_within(t.events.select("user_id", "event_id", "value"), ["user_id"], "value", "event_id", 11)
    return out.select("user_id", "event_id", r6(F.col("shuffled")).alias("shuffled"))


ARMS = """arms AS (SELECT l_orderkey AS clip, l_suppkey AS subject, CASE WHEN l_linenumber % 2 = 0 THEN 'native' ELSE 'slow' END AS arm, max(l_quantity) AS mae
  FROM lineitem GROUP BY 1, 2, 3),
wide AS (SELECT clip, subject, max(mae) FILTER (WHERE arm = 'native') AS a, max(mae) FILTER (WHERE arm = 'slow') AS b FROM arms GROUP BY 1, 2),
pen AS (SELECT subject, avg(b) - avg(a) AS penalty, count(*) AS n_clips FROM wide WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1)"""


def arms(t: Tables) -> DataFrame:
    arm = F.when(F.col("l_linenumber") % 2 == 0, "native").otherwise("slow")
    return t.lineitem.groupBy(F.col("l_orderkey").alias("clip"), F.col("l_suppkey").alias("subject"), arm.alias("arm")).agg(
        F.max("l_quantity").alias("mae"))


@query("j13_paired_configuration", f"WITH {ARMS} SELECT subject, n_clips, round(penalty, 6) + 0.0 AS delta FROM pen")
def _(t):
    a = arms(t)
    base = a.filter("arm = 'native'").select("clip", "subject", F.col("mae").alias("_a"))
    other = a.filter("arm = 'slow'").select("clip", "subject", F.col("mae").alias("_b"))
    return base.join(other, ["clip", "subject"]).groupBy("subject").agg(
        F.count(F.lit(1)).alias("n_clips"), r6(F.avg("_b") - F.avg("_a")).alias("delta"))


@query("e32_paired_penalty", f"""WITH {ARMS}, {_draws('pen', '', 'subject', REPLICATES, 13, 'dr')},
m AS (SELECT rep, sum(w * penalty) / sum(w) AS m FROM dr JOIN pen USING (subject) GROUP BY 1),
q AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m)
SELECT count(*) AS n_subjects, round(avg(penalty), 6) + 0.0 AS penalty, round(max(lo), 6) + 0.0 AS lo, round(max(hi), 6) + 0.0 AS hi, max(lo) > 0 OR max(hi) < 0 AS resolved FROM pen, q""")
def _(t):
    out = ev.paired_penalty(arms(t), ["clip"], "subject", "arm", "native", "slow", "mae", REPLICATES, 13)
    return out.select("n_subjects", "resolved", *[r6(F.col(c)).alias(c) for c in ("penalty", "lo", "hi")])


@query("e34_identity_check", """SELECT l_suppkey AS subject, round(avg(l_extendedprice - l_quantity) - (avg(l_extendedprice) - avg(l_quantity)), 5) + 0.0 AS residual,
  abs(avg(l_extendedprice - l_quantity) - (avg(l_extendedprice) - avg(l_quantity))) < 1e-5 AS holds FROM lineitem GROUP BY 1""")
def _(t):
    gap = F.avg(F.col("l_extendedprice") - F.col("l_quantity")) - (F.avg("l_extendedprice") - F.avg("l_quantity"))
    return t.lineitem.groupBy(F.col("l_suppkey").alias("subject")).agg((F.round(gap, 5) + 0.0).alias("residual"), (F.abs(gap) < 1e-5).alias("holds"))


@query("e20_modal_baseline", f"""WITH {FOLD_SCORES},
tr AS (SELECT a.seed, b.k AS fold, a.wave, count(*) AS n FROM fs a, (SELECT unnest(generate_series(0, 4)) AS k) b WHERE a.fold <> b.k GROUP BY 1, 2, 3),
md AS (SELECT seed, fold, arg_max(wave, struct_pack(n := n, w := -wave)) AS modal FROM tr GROUP BY 1, 2)
SELECT seed, CAST(fold AS INTEGER) AS fold, modal, round(avg(CASE WHEN wave = modal THEN 1.0 ELSE 0 END), 6) AS baseline FROM fs JOIN md USING (seed, fold) GROUP BY 1, 2, 3""")
def _(t):
    """Accuracy of always guessing the training side's most common wave (earliest on ties)."""
    fs = fold_scores(t)
    per = fs.groupBy("seed", "fold", "wave").agg(F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("seed", "wave").agg(F.sum("n").alias("_all"))
    train = (whole.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(5)])))
             .join(per, ["seed", "fold", "wave"], "left")
             .withColumn("_n", F.col("_all") - F.coalesce("n", F.lit(0))))
    modal = train.groupBy("seed", "fold").agg(F.max_by("wave", F.struct("_n", -F.col("wave"))).alias("modal"))
    return fs.join(modal, FOLD).groupBy("seed", "fold", "modal").agg(
        r6(F.avg((F.col("wave") == F.col("modal")).cast("double"))).alias("baseline"))


@query("w23_first_crossing", """WITH s AS (SELECT l_suppkey % 30 AS grp, l_quantity AS x, avg(l_extendedprice) / 1000 AS y FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM s WINDOW w AS (PARTITION BY grp ORDER BY x)),
c AS (SELECT grp, x0 + (50 - y0) / (y - y0) * (x - x0) AS at, row_number() OVER (PARTITION BY grp ORDER BY x) AS rn FROM p WHERE y0 < 50 AND y >= 50)
SELECT g.grp, round(c.at, 6) AS crossing FROM (SELECT DISTINCT grp FROM s) g LEFT JOIN c ON c.grp = g.grp AND rn = 1""")
def _(t):
    sweep = t.lineitem.groupBy((F.col("l_suppkey") % 30).alias("grp"), F.col("l_quantity").alias("x")).agg((F.avg("l_extendedprice") / 1000).alias("y"))
    return st.first_crossing(sweep, ["grp"], "x", "y", 50.0).withColumn("crossing", r6(F.col("crossing")))


FAMILIES = {"p": "logit", "q": "boosted"}


@query("w27_best_family", f"""WITH {FOLD_SCORES}, {_auc('fs', 'seed, fold', 'p', 'a')}, {_auc('fs', 'seed, fold', 'q', 'b')},
al AS (SELECT seed, 'logit' AS family, avg(auc) AS auc FROM a GROUP BY 1 UNION ALL SELECT seed, 'boosted', avg(auc) FROM b GROUP BY 1)
SELECT seed, arg_max(family, auc) AS family, round(max(auc), 6) AS auc FROM al GROUP BY 1""")
def _(t):
    fs = fold_scores(t)
    parts = [ev.auc(fs, FOLD, "y", c).groupBy("seed").agg(F.avg("auc").alias("auc")).withColumn("family", F.lit(n))
             for c, n in FAMILIES.items()]
    return parts[0].unionByName(parts[1]).groupBy("seed").agg(
        F.max_by("family", "auc").alias("family"), r6(F.max("auc")).alias("auc"))


@query("a38_saturation", f"""WITH {SCORED},
lv AS (SELECT f, y, p FROM scored, (SELECT unnest([25, 50, 75, 100]) AS f) WHERE {_hash('subject', "'keep'")} % 100 < f), {_auc('lv', 'f', 'p', 'a')},
d AS (SELECT f, auc, auc - lag(auc) OVER (ORDER BY f) AS inc FROM a)
SELECT round(arg_max(auc, f) - arg_min(auc, f), 6) + 0.0 AS gain, round(arg_max(inc, f), 6) + 0.0 AS last_increment, round(arg_max(inc, f), 9) <= 0.01 AS saturated FROM d""")
def _(t):
    levels = joins.grid(scored(t), f=[25, 50, 75, 100]).filter(portable_hash(F.col("subject"), F.lit("keep")) % 100 < F.col("f"))
    out = st.saturation(ev.auc(levels, ["f"], "y", "p"), "f", "auc")
    return out.select(r6(F.col("gain")).alias("gain"), r6(F.col("last_increment")).alias("last_increment"), "saturated")


@query("j14_parameter_grid", """SELECT o_orderkey, side, CAST(k AS INTEGER) AS k FROM orders, (SELECT unnest(['L', 'R']) AS side), (SELECT unnest([15, 30, 60]) AS k)""")
def _(t):
    return joins.grid(t.orders.select("o_orderkey"), side=["L", "R"], k=[15, 30, 60])
