"""Series queries: the events of each user, split by side, are the per-frame series."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin.functions.numeric import r6
from tempograin.operators import series as ops
from tempograin.operators.ordered import interval_join, quantiles
from tempograin.plans.registry import query
from tempograin.sources.tables import Tables

FPS = 5.0
CLIP = ["user_id"]
LEG = ["user_id", "side"]


def leg_frames(t: Tables) -> DataFrame:
    """(user, side, frame, value): every 17th event is a dropped sample."""
    rows = t.events.select(
        "user_id", "ts", "event_id",
        F.when(F.col("event_id") % 2 == 0, "L").otherwise("R").alias("side"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"))
    return ops.number_frames(rows, LEG, ["ts", "event_id"])


def clip_frames(t: Tables) -> DataFrame:
    """(user, frame, value): one series per user over both sides."""
    rows = t.events.select("user_id", "ts", "event_id", "event_type", "value")
    return ops.number_frames(rows, CLIP, ["ts", "event_id"])


def filled_legs(t: Tables) -> DataFrame:
    return ops.fill_short_gaps(leg_frames(t), LEG, FPS).select(
        *LEG, "frame", F.col("filled").alias("value"))


def leg_cycles(t: Tables) -> DataFrame:
    return ops.cycles(ops.hysteresis_events(filled_legs(t), LEG), LEG, FPS)


# --- the same steps in SQL, as a chain of common table expressions

LEGS = """
legs AS (
  SELECT user_id, CASE WHEN event_id % 2 = 0 THEN 'L' ELSE 'R' END AS side, event_id, ts,
         CASE WHEN event_id % 17 <> 0 THEN value END AS value,
         row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) - 1 AS frame
  FROM events)"""
CLIPS = """
clips AS (
  SELECT user_id, event_id, event_type, ts, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame
  FROM events)"""
FILLED = LEGS + """,
near AS (
  SELECT user_id, side, frame, value,
    last_value(CASE WHEN value IS NOT NULL THEN frame END IGNORE NULLS)
      OVER (PARTITION BY user_id, side ORDER BY frame) AS f0,
    last_value(value IGNORE NULLS) OVER (PARTITION BY user_id, side ORDER BY frame) AS v0,
    first_value(CASE WHEN value IS NOT NULL THEN frame END IGNORE NULLS)
      OVER (PARTITION BY user_id, side ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f1,
    first_value(value IGNORE NULLS)
      OVER (PARTITION BY user_id, side ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1
  FROM legs),
filled AS (
  SELECT user_id, side, frame, value AS raw,
    CASE WHEN value IS NOT NULL THEN value
         WHEN f1 - f0 - 1 <= 1 THEN v0 + (v1 - v0) * ((frame - f0)::DOUBLE / (f1 - f0)) END AS value
  FROM near)"""
EVENTS = FILLED + """,
swing AS (
  SELECT user_id, side, count(value) AS n, quantile_cont(value, 0.05) AS p05, quantile_cont(value, 0.95) AS p95
  FROM filled GROUP BY 1, 2),
bands AS (
  SELECT user_id, side, 0.5 * (p05 + p95) - 0.5 * 0.25 * (p95 - p05) AS low,
         0.5 * (p05 + p95) + 0.5 * 0.25 * (p95 - p05) AS high
  FROM swing WHERE n >= 4 AND p95 - p05 >= 1e-9),
state AS (
  SELECT f.user_id, f.side, f.frame, f.value,
    coalesce(last_value(CASE WHEN f.value > b.high THEN 1 WHEN f.value < b.low THEN 0 END IGNORE NULLS)
      OVER (PARTITION BY f.user_id, f.side ORDER BY f.frame), 0) AS st
  FROM filled f JOIN bands b USING (user_id, side) WHERE f.value IS NOT NULL),
edge AS (
  SELECT *, CASE WHEN st = 1 AND coalesce(lag(st) OVER (PARTITION BY user_id, side ORDER BY frame), 0) = 0
                 THEN 1 ELSE 0 END AS up FROM state),
island AS (
  SELECT *, sum(up) OVER (PARTITION BY user_id, side ORDER BY frame) AS k FROM edge),
ranked AS (
  SELECT user_id, side, k, frame, value,
    row_number() OVER (PARTITION BY user_id, side, k ORDER BY value DESC, frame) AS rn
  FROM island WHERE st = 1),
closed AS (SELECT DISTINCT user_id, side, k FROM island WHERE k > 0 AND st = 0),
peaks AS (
  SELECT user_id, side, CAST(k AS BIGINT) AS event_id, frame, value AS peak
  FROM ranked JOIN closed USING (user_id, side, k) WHERE rn = 1)"""
CYCLES = EVENTS + """,
cyc AS (
  SELECT user_id, side, event_id AS cycle_id, frame AS lo, hi, (hi - frame) / 5.0::DOUBLE AS duration_s,
         (hi - frame) / 5.0::DOUBLE BETWEEN 0.4::DOUBLE AND 1.4::DOUBLE AS plausible
  FROM (SELECT *, lead(frame) OVER (PARTITION BY user_id, side ORDER BY event_id) AS hi FROM peaks)
  WHERE hi IS NOT NULL)"""
CYCLE_STATS = CYCLES + """,
stats AS (
  SELECT user_id, side, count(*) AS n_cycles, count(*) FILTER (WHERE plausible) AS n_used,
         avg(CASE WHEN plausible THEN 1.0 ELSE 0.0 END) AS plausible_share,
         CASE WHEN count(*) FILTER (WHERE plausible) >= 2
              THEN (stddev_samp(duration_s) FILTER (WHERE plausible)) / (avg(duration_s) FILTER (WHERE plausible)) END AS duration_cv,
         120.0 / avg(duration_s) FILTER (WHERE plausible) AS cadence
  FROM cyc GROUP BY 1, 2)"""


@query("w03_gap_fill", f"""WITH {FILLED}
SELECT user_id, side, frame, round(value, 6) + 0.0 AS filled FROM filled""")
def _(t):
    return ops.fill_short_gaps(leg_frames(t), LEG, FPS).select(*LEG, "frame", r6(F.col("filled")).alias("filled"))


@query("w04_swing_amplitude", f"""WITH {LEGS}
SELECT user_id, side, count(value) AS n, round(quantile_cont(value, 0.05), 6) AS p05,
       round(quantile_cont(value, 0.95), 6) AS p95,
       CASE WHEN count(value) >= 4
            THEN round(quantile_cont(value, 0.95) - quantile_cont(value, 0.05), 6) END AS amplitude
FROM legs GROUP BY 1, 2""")
def _(t):
    out = ops.swing(leg_frames(t), LEG)
    return out.select(*LEG, "n", *[r6(F.col(c)).alias(c) for c in ("p05", "p95", "amplitude")])


@query("w05_hysteresis_events", f"""WITH {EVENTS}
SELECT user_id, side, event_id, frame, round(peak, 6) AS peak FROM peaks""")
def _(t):
    return (ops.hysteresis_events(filled_legs(t), LEG)
            .select(*LEG, "event_id", "frame", r6(F.col("peak")).alias("peak")))


@query("w06_cycles", f"""WITH {CYCLES}
SELECT user_id, side, cycle_id, lo, hi, round(duration_s, 6) AS duration_s, plausible FROM cyc""")
def _(t):
    return leg_cycles(t).select(*LEG, "cycle_id", "lo", "hi", r6(F.col("duration_s")).alias("duration_s"), "plausible")


@query("w07_cycle_verdict", f"""WITH {CYCLE_STATS},
raw_swing AS (
  SELECT user_id, side, CASE WHEN count(raw) >= 4
         THEN quantile_cont(raw, 0.95) - quantile_cont(raw, 0.05) END AS amplitude
  FROM filled GROUP BY 1, 2),
side_rows AS (
  SELECT r.user_id, r.side, r.amplitude, coalesce(s.n_cycles, 0) AS n_cycles, coalesce(s.n_used, 0) AS n_used,
         s.plausible_share
  FROM raw_swing r LEFT JOIN stats s USING (user_id, side)),
wide AS (
  SELECT user_id,
    max(n_cycles) FILTER (WHERE side = 'L') AS n_cycles_l, max(n_cycles) FILTER (WHERE side = 'R') AS n_cycles_r,
    max(n_used) FILTER (WHERE side = 'L') AS n_used_l, max(n_used) FILTER (WHERE side = 'R') AS n_used_r,
    max(amplitude) FILTER (WHERE side = 'L') AS amp_l, max(amplitude) FILTER (WHERE side = 'R') AS amp_r,
    max(plausible_share) FILTER (WHERE side = 'L') AS share_l,
    max(plausible_share) FILTER (WHERE side = 'R') AS share_r
  FROM side_rows GROUP BY 1),
judged AS (
  SELECT *, concat_ws('; ',
    CASE WHEN coalesce(n_used_l, 0) < 3 THEN 'l: too few cycles' END,
    CASE WHEN coalesce(amp_l, 0) < 25 THEN 'l: swing too small' END,
    CASE WHEN share_l < 0.6 THEN 'l: implausible cycles' END,
    CASE WHEN coalesce(n_used_r, 0) < 3 THEN 'r: too few cycles' END,
    CASE WHEN coalesce(amp_r, 0) < 25 THEN 'r: swing too small' END,
    CASE WHEN share_r < 0.6 THEN 'r: implausible cycles' END,
    CASE WHEN abs(coalesce(n_cycles_l, 0) - coalesce(n_cycles_r, 0)) > 1
         THEN 'sides disagree on the count' END) AS reasons
  FROM wide)
SELECT user_id, n_cycles_l, n_cycles_r, n_used_l, n_used_r, round(amp_l, 6) AS amplitude_l,
       round(amp_r, 6) AS amplitude_r, round(share_l, 6) AS plausible_share_l,
       round(share_r, 6) AS plausible_share_r, reasons, reasons = '' AS ok
FROM judged""")
def _(t):
    out = ops.segmentation_verdict(leg_frames(t), "user_id", "side", FPS)
    return out.select(
        "user_id", "n_cycles_l", "n_cycles_r", "n_used_l", "n_used_r",
        *[r6(F.col(c)).alias(c) for c in ("amplitude_l", "amplitude_r", "plausible_share_l", "plausible_share_r")],
        F.concat_ws("; ", "reasons").alias("reasons"), "ok")


@query("w08_cycle_summary", f"""WITH {CYCLE_STATS}
SELECT user_id, side, n_cycles, n_used, round(plausible_share, 6) AS plausible_share,
       round(duration_cv, 6) AS duration_cv, round(cadence, 6) AS cadence FROM stats""")
def _(t):
    out = ops.cycle_summary(leg_cycles(t), LEG)
    return out.select(*LEG, "n_cycles", "n_used",
                      *[r6(F.col(c)).alias(c) for c in ("plausible_share", "duration_cv", "cadence")])


@query("w09_dominant_period", f"""WITH {LEGS},
kept AS (
  SELECT user_id, side, value, row_number() OVER (PARTITION BY user_id, side ORDER BY frame) - 1 AS pos,
         avg(value) OVER (PARTITION BY user_id, side) AS m, count(*) OVER (PARTITION BY user_id, side) AS n
  FROM legs WHERE value IS NOT NULL),
power AS (SELECT user_id, side, max(n) AS n, sum((value - m) * (value - m)) AS p FROM kept GROUP BY 1, 2),
scored AS (
  SELECT a.user_id, a.side, k.lag, round(sum((a.value - a.m) * (b.value - b.m)) / max(p.p), 9) AS r
  FROM kept a CROSS JOIN (SELECT unnest(generate_series(2, 10)) AS lag) k
  JOIN kept b ON b.user_id = a.user_id AND b.side = a.side AND b.pos = a.pos + k.lag
  JOIN power p ON p.user_id = a.user_id AND p.side = a.side
  WHERE k.lag <= p.n - 2 AND p.n >= 5 AND p.p >= 1e-18 AND least(10, p.n - 2) > 2 GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY user_id, side ORDER BY r DESC, lag) AS rn FROM scored)
SELECT p.user_id, p.side, CAST(b.lag AS BIGINT) AS period, round(b.r, 6) + 0.0 AS strength
FROM power p LEFT JOIN best b ON b.user_id = p.user_id AND b.side = p.side AND b.rn = 1""")
def _(t):
    out = ops.dominant_period(leg_frames(t), LEG, 2, 10)
    return out.select(*LEG, "period", r6(F.col("strength")).alias("strength"))


@query("w10_peak_per_cycle", f"""WITH {CYCLES}
SELECT c.user_id, c.side, c.cycle_id, round(max(f.value), 6) AS peak
FROM cyc c JOIN filled f ON f.user_id = c.user_id AND f.side = c.side AND f.frame BETWEEN c.lo AND c.hi
GROUP BY 1, 2, 3""")
def _(t):
    out = ops.peak_per_cycle(filled_legs(t), leg_cycles(t), LEG)
    return out.select(*LEG, "cycle_id", r6(F.col("peak")).alias("peak"))


@query("w11_longest_run", f"""WITH {CLIPS},
runs AS (
  SELECT user_id, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS g, frame
  FROM clips WHERE value < 50),
spans AS (SELECT user_id, min(frame) AS lo, max(frame) AS hi, count(*) AS n FROM runs GROUP BY user_id, g)
SELECT user_id, lo, hi, n FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, lo) AS rn FROM spans) WHERE rn = 1""")
def _(t):
    return ops.longest_run(clip_frames(t), CLIP, F.col("value") < 50)


def named_spans(t: Tables) -> DataFrame:
    """Named windows of five frames, starting at every purchase; some overlap."""
    return (clip_frames(t).filter("event_type = 'purchase'")
            .select("user_id", F.col("frame").alias("lo"), (F.col("frame") + 5).alias("hi"),
                    F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("motion")))


SPANS = CLIPS + """,
spans AS (
  SELECT user_id, frame AS lo, frame + 5 AS hi, 'm' || event_id::VARCHAR AS motion
  FROM clips WHERE event_type = 'purchase')"""
BARE = SPANS + """,
bare AS (
  SELECT user_id, frame, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS g
  FROM clips c WHERE NOT EXISTS (
    SELECT 1 FROM spans s WHERE s.user_id = c.user_id AND c.frame >= s.lo AND c.frame < s.hi)),
gaps AS (
  SELECT user_id, min(frame) AS lo, max(frame) AS hi, count(*) AS n
  FROM bare GROUP BY user_id, g HAVING count(*) >= 3)"""


@query("j09_interval_join", f"""WITH {SPANS}
SELECT s.user_id, s.motion, count(*) AS n_frames, round(avg(c.value), 6) AS mean_value
FROM clips c JOIN spans s ON s.user_id = c.user_id AND c.frame >= s.lo AND c.frame < s.hi GROUP BY 1, 2""")
def _(t):
    inside = interval_join(clip_frames(t).select("user_id", "frame", "value"), named_spans(t), CLIP, "frame", "lo", "hi")
    return inside.groupBy("user_id", "motion").agg(
        F.count(F.lit(1)).alias("n_frames"), r6(F.avg("value")).alias("mean_value"))


@query("w12_uncovered_runs", f"WITH {BARE} SELECT user_id, lo, hi, n FROM gaps")
def _(t):
    return ops.uncovered_runs(clip_frames(t), named_spans(t), CLIP, 3)


@query("j15_nearest_label", f"""WITH {BARE},
near AS (
  SELECT g.user_id, g.lo, g.hi, s.motion,
         row_number() OVER (PARTITION BY g.user_id, g.lo ORDER BY abs(s.lo - (g.hi + 1)), s.lo) AS rn
  FROM gaps g JOIN spans s ON s.user_id = g.user_id)
SELECT user_id, lo, hi, motion AS nearest_motion FROM near WHERE rn = 1""")
def _(t):
    gaps = ops.uncovered_runs(clip_frames(t), named_spans(t), CLIP, 3)
    found = ops.nearest_label(gaps, named_spans(t), CLIP, "motion")
    return found.filter(F.col("nearest_motion").isNotNull())


@query("w13_speed", f"""WITH {CLIPS},
moved AS (
  SELECT user_id, frame, sqrt(power(value - lag(value) OVER w, 2) +
         power(date_part('epoch', ts)::BIGINT % 97 - lag(date_part('epoch', ts)::BIGINT % 97) OVER w, 2)) * 5 AS speed
  FROM (SELECT user_id, frame, value, date_trunc('second', ts) AS ts FROM clips)
  WINDOW w AS (PARTITION BY user_id ORDER BY frame))
SELECT user_id, count(speed) AS n, round(quantile_cont(speed, 0.5), 6) AS median_speed FROM moved GROUP BY 1""")
def _(t):
    points = clip_frames(t).select("user_id", "frame", F.col("value").alias("x"),
                                   F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) % 97").cast("double").alias("y"))
    moved = ops.speeds(points, CLIP, ["x", "y"], FPS)
    sizes = moved.groupBy("user_id").agg(F.count("speed").alias("n"))
    return sizes.join(quantiles(moved, CLIP, "speed", {"median_speed": 0.5}), CLIP).select(
        "user_id", "n", r6(F.col("median_speed")).alias("median_speed"))


@query("w16_stance_fraction", f"""WITH {CLIPS},
ends AS (SELECT user_id, max(frame) AS last_frame FROM clips GROUP BY 1),
runs AS (
  SELECT user_id, frame, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS g
  FROM clips WHERE value > 30),
contact AS (
  SELECT r.user_id, min(frame) AS lo, max(frame) AS hi, count(*) AS n FROM runs r JOIN ends USING (user_id)
  GROUP BY r.user_id, g HAVING count(*) >= 2 AND min(frame) > 0 AND max(frame) < max(last_frame)),
strides AS (
  SELECT user_id, n / (lead(lo, 2) OVER (PARTITION BY user_id ORDER BY lo) - lo)::DOUBLE AS share FROM contact)
SELECT user_id, count(*) AS n_strides, round(quantile_cont(share, 0.5), 6) AS median_share
FROM strides WHERE share > 0.15 AND share < 0.75 GROUP BY 1""")
def _(t):
    out = ops.stance_fraction(clip_frames(t), CLIP, 30.0, 2)
    return out.select("user_id", "n_strides", r6(F.col("median_share")).alias("median_share"))


@query("w17_zero_crossing_rate", f"""WITH {CLIPS},
centred AS (SELECT user_id, frame, value > avg(value) OVER (PARTITION BY user_id) AS up FROM clips),
stepped AS (SELECT user_id, up <> lag(up) OVER (PARTITION BY user_id ORDER BY frame) AS crossed FROM centred),
rates AS (
  SELECT user_id, count(*) FILTER (WHERE crossed) AS crossings, count(*) AS n FROM stepped GROUP BY 1)
SELECT user_id, crossings, n, round(crossings / (2.0 * n), 6) AS cycles_per_frame FROM rates""")
def _(t):
    out = ops.zero_crossing_rate(clip_frames(t), CLIP)
    return out.select("user_id", "crossings", "n", r6(F.col("cycles_per_frame")).alias("cycles_per_frame"))


@query("w17_implied_rate", f"""WITH {CLIPS},
centred AS (SELECT user_id, frame, value > avg(value) OVER (PARTITION BY user_id) AS up FROM clips),
stepped AS (SELECT user_id, up <> lag(up) OVER (PARTITION BY user_id ORDER BY frame) AS crossed FROM centred),
rates AS (
  SELECT user_id, (count(*) FILTER (WHERE crossed)) / (2.0 * count(*)) AS spf FROM stepped
  GROUP BY 1 HAVING count(*) FILTER (WHERE crossed) >= 2)
SELECT count(*) AS n_clips, round(quantile_cont(spf, 0.5), 6) AS cycles_per_frame,
       round(2.5 / quantile_cont(spf, 0.5), 6) AS hz_low, round(3.0 / quantile_cont(spf, 0.5), 6) AS hz_high
FROM rates""")
def _(t):
    rates = ops.zero_crossing_rate(clip_frames(t), CLIP).filter("crossings >= 2")
    mid = quantiles(rates, [], "cycles_per_frame", {"m": 0.5}).scalar()
    return rates.agg(F.count(F.lit(1)).alias("n_clips")).withColumn("m", mid).select(
        "n_clips", r6(F.col("m")).alias("cycles_per_frame"), r6(2.5 / F.col("m")).alias("hz_low"),
        r6(3.0 / F.col("m")).alias("hz_high"))


PERIODS = """,
kept AS (
  SELECT user_id, side, value, row_number() OVER (PARTITION BY user_id, side ORDER BY frame) - 1 AS pos,
         avg(value) OVER (PARTITION BY user_id, side) AS m
  FROM filled WHERE value IS NOT NULL),
power AS (SELECT user_id, side, count(*) AS n, sum((value - m) * (value - m)) AS p FROM kept GROUP BY 1, 2),
scored AS (
  SELECT a.user_id, a.side, k.lag, round(sum((a.value - a.m) * (b.value - b.m)) / max(p.p), 9) AS r
  FROM kept a CROSS JOIN (SELECT unnest(generate_series(2, 10)) AS lag) k
  JOIN kept b ON b.user_id = a.user_id AND b.side = a.side AND b.pos = a.pos + k.lag
  JOIN power p ON p.user_id = a.user_id AND p.side = a.side
  WHERE k.lag <= p.n - 2 AND p.n >= 5 AND p.p >= 1e-18 AND least(10, p.n - 2) > 2 GROUP BY 1, 2, 3),
periods AS (
  SELECT user_id, side, lag AS period FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, side ORDER BY r DESC, lag) AS rn FROM scored) WHERE rn = 1)"""


def _negated_events():
    """The event chain again on the sign-flipped series, for the minima."""
    tail = EVENTS.split("swing AS (", 1)[1]
    names = ["swing", "bands", "state", "edge", "island", "ranked", "closed", "peaks", "filled"]
    text = "flip_filled AS (SELECT user_id, side, frame, -value AS value FROM filled), swing AS (" + tail
    for n in names:
        text = re.sub(rf"\b(?<!flip_){n}\b(?! AS value FROM filled)", f"flip_{n}", text)
    return text.replace("FROM flip_filled), flip_swing", "FROM filled), flip_swing")


@query("w18_duty_fraction", f"""WITH {EVENTS}, {_negated_events()} {PERIODS}
SELECT p.user_id, p.side, p.frame, min(m.frame) AS next_min,
       round((min(m.frame) - p.frame) / max(d.period)::DOUBLE, 6) AS duty
FROM peaks p JOIN flip_peaks m ON m.user_id = p.user_id AND m.side = p.side AND m.frame > p.frame
JOIN periods d ON d.user_id = p.user_id AND d.side = p.side GROUP BY 1, 2, 3""")
def _(t):
    legs = filled_legs(t)
    highs = ops.hysteresis_events(legs, LEG)
    lows = ops.hysteresis_events(legs.withColumn("value", -F.col("value")), LEG)
    out = ops.duty_fraction(highs, lows, ops.dominant_period(legs, LEG, 2, 10), LEG)
    return out.select(*LEG, "frame", "next_min", r6(F.col("duty")).alias("duty"))


@query("w20_decimate", f"""WITH {CLIPS}
SELECT user_id, frame, round(value, 6) AS value FROM clips WHERE frame % 4 = 0""")
def _(t):
    return clip_frames(t).filter(F.col("frame") % 4 == 0).select("user_id", "frame", r6(F.col("value")).alias("value"))


@query("w20_nearest_ticks", f"""WITH {CLIPS},
sizes AS (SELECT user_id, count(*) AS n FROM clips GROUP BY 1),
ticks AS (
  SELECT DISTINCT user_id, CAST(round_even(k * 1.25::DOUBLE, 0) AS BIGINT) AS frame, n
  FROM (SELECT user_id, n, unnest(generate_series(0, CAST(floor((n - 1) / 1.25::DOUBLE) AS BIGINT))) AS k FROM sizes))
SELECT t.user_id, t.frame, round(c.value, 6) AS value FROM ticks t JOIN clips c USING (user_id, frame)""")
def _(t):
    frames = clip_frames(t)
    sizes = frames.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_frames"))
    ticks = ops.nearest_ticks(sizes, CLIP, 5.0, 4.0)
    return ticks.join(frames, ["user_id", "frame"]).select("user_id", "frame", r6(F.col("value")).alias("value"))


@query("p22_centre_window", f"""WITH {CLIPS},
sized AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM clips)
SELECT user_id, frame, round(value, 6) AS value FROM sized
WHERE frame >= CASE WHEN n <= 40 THEN 0 ELSE (n - 40) // 2 END
  AND frame < CASE WHEN n <= 40 THEN 0 ELSE (n - 40) // 2 END + 40""")
def _(t):
    out = ops.centre_window(clip_frames(t), CLIP, int(8 * FPS))
    return out.select("user_id", "frame", r6(F.col("value")).alias("value"))


@query("w28_lag_scan", f"""WITH {CLIPS},
two AS (
  SELECT user_id, frame, value AS x, lead(value, 2) OVER (PARTITION BY user_id ORDER BY frame) +
         (event_id % 7) AS y FROM clips),
pairs AS (
  SELECT a.user_id, k.lag, a.x, b.y
  FROM two a CROSS JOIN (SELECT unnest(generate_series(-12, 12)) AS lag) k
  JOIN two b ON b.user_id = a.user_id AND b.frame = a.frame + k.lag
  WHERE a.x IS NOT NULL AND b.y IS NOT NULL),
rs AS (
  SELECT user_id, lag, round(CASE WHEN stddev_pop(x) >= 1e-12 AND stddev_pop(y) >= 1e-12
         THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 9) AS r FROM pairs GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(r) DESC, lag) AS rn FROM rs WHERE r IS NOT NULL),
zero AS (SELECT user_id, r AS r0 FROM rs WHERE lag = 0)
SELECT u.user_id, CAST(b.lag AS BIGINT) AS best_lag, round(b.r, 6) + 0.0 AS best_r, round(z.r0, 6) + 0.0 AS r0,
       CAST(CASE WHEN abs(b.r) - coalesce(abs(z.r0), 0) >= 0.15 THEN b.lag ELSE 0 END AS BIGINT) AS used_lag
FROM (SELECT DISTINCT user_id FROM clips) u LEFT JOIN best b ON b.user_id = u.user_id AND b.rn = 1
LEFT JOIN zero z ON z.user_id = u.user_id""")
def _(t):
    frames = clip_frames(t)
    ahead = ops.shifted(frames.select("user_id", "frame", "value", "event_id"), CLIP, {"value": "_later"}, 2)
    two = ahead.select("user_id", "frame", F.col("value").alias("x"),
                       (F.col("_later") + F.col("event_id") % 7).alias("y"))
    out = ops.lag_scan(two, CLIP, "x", "y", 12)
    return out.select("user_id", "best_lag", r6(F.col("best_r")).alias("best_r"), r6(F.col("r0")).alias("r0"), "used_lag")
