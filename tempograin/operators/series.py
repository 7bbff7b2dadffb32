"""Per-frame series: gaps, amplitude, hysteresis events, cycles, rates, stillness.

A series is a long table with group ``keys`` (clip, side, ...), a dense 0-based ``frame``
and a nullable ``value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograin.functions.numeric import correlation, ratio
from tempograin.operators.ordered import (
    Index, Known, Neighbour, RunningSum, block_window, cut, interval_join, join_same, quantiles,
    runs, with_halo)

# Fixed values of the method: plausible cycle length in seconds, trigger band as a share
# of the amplitude, and the bars a segmentation must clear.
CYCLE_S = (0.40, 1.40)
BAND_SHARE = 0.25
MIN_CYCLES = 3
MIN_SWING = 25.0
MIN_PLAUSIBLE = 0.60
MAX_COUNT_GAP = 1
MAX_GAP_S = 0.20


def number_frames(df: DataFrame, keys: list[str], order: list[str], name: str = "frame") -> DataFrame:
    """Give every row its dense 0-based position in its group."""
    return cut(df, keys, order).add(**{name: Index()}).rows()


def fill_short_gaps(series: DataFrame, keys: list[str], fps: float,
                    max_gap_s: float = MAX_GAP_S, name: str = "filled") -> DataFrame:
    """Interpolate NULL runs of at most ``max_gap_s``; never at either end."""
    limit = max(1, int(round(max_gap_s * fps)))
    point = F.when(F.col("value").isNotNull(), F.struct("frame", "value"))
    seen = cut(series, keys, ["frame"]).add(
        _before=Known(point), _after=Known(point, backward=True)).rows()
    lo, hi = F.col("_before"), F.col("_after")
    gap = hi["frame"] - lo["frame"] - 1
    line = lo["value"] + (hi["value"] - lo["value"]) * (
        (F.col("frame") - lo["frame"]) / F.nullif(hi["frame"] - lo["frame"], F.lit(0)))
    filled = F.when(F.col("value").isNotNull(), F.col("value")).when(gap <= limit, line)
    return seen.withColumn(name, filled).drop("_before", "_after")


def swing(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """5th and 95th percentile and their range; the range is NULL below four values."""
    spread = quantiles(series, keys, value, {"p05": 0.05, "p95": 0.95})
    sizes = series.groupBy(*keys).agg(F.count(value).alias("n"))
    return (join_same(sizes, spread, keys)
            .withColumn("amplitude", F.when(F.col("n") >= 4, F.col("p95") - F.col("p05"))))


def hysteresis_events(series: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """One event per closed excursion: the frame of its first maximum.

    A value above the band opens an excursion, one below closes it, values inside keep
    the state. NULLs are skipped. A flat or too short series has no events.
    """
    half = 0.5 * BAND_SHARE * F.col("amplitude")
    mid = 0.5 * (F.col("p05") + F.col("p95"))
    bands = (swing(series, keys, value).filter(F.col("amplitude") >= 1e-9)
             .select(*keys, (mid - half).alias("_low"), (mid + half).alias("_high")))
    rows = join_same(series.filter(F.col(value).isNotNull()).select(*keys, "frame", value), bands, keys)
    cross = F.when(F.col(value) > F.col("_high"), 1).when(F.col(value) < F.col("_low"), 0)
    stated = cut(rows, keys, ["frame"]).add(_state=Known(cross))
    above = F.coalesce(F.col("_state"), F.lit(0))
    stepped = stated.add(_was=Neighbour(above))
    rising = ((above == 1) & (F.coalesce(F.col("_was"), F.lit(0)) == 0)).cast("long")
    islands = stepped.add(_excursion=RunningSum(rising)).rows().filter(F.col("_excursion") > 0)
    peaks = islands.groupBy(*keys, "_excursion").agg(
        F.max(F.when(above == 1, F.struct(F.col(value).alias("v"), (-F.col("frame")).alias("f")))).alias("_top"),
        F.max((above == 0).cast("int")).alias("_closed"))
    return (peaks.filter("_closed = 1")
            .select(*keys, F.col("_excursion").alias("event_id"), (-F.col("_top")["f"]).alias("frame"),
                    F.col("_top")["v"].alias("peak")))


def cycles(events: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """Consecutive events as cycles ``lo``-``hi`` with their length in seconds."""
    paired = cut(events, keys, ["event_id"]).add(hi=Neighbour(F.col("frame"), backward=True)).rows()
    length = (F.col("hi") - F.col("frame")) / F.lit(float(fps))
    return (paired.filter(F.col("hi").isNotNull())
            .select(*keys, F.col("event_id").alias("cycle_id"), F.col("frame").alias("lo"), "hi",
                    length.alias("duration_s"))
            .withColumn("plausible", F.col("duration_s").between(*CYCLE_S)))


def cycle_summary(all_cycles: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, plausible share, duration spread and cadence per group."""
    used = F.when(F.col("plausible"), F.col("duration_s"))
    return all_cycles.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cycles"),
        F.count(used).alias("n_used"),
        F.avg(F.col("plausible").cast("double")).alias("plausible_share"),
        ratio(F.stddev_samp(used), F.avg(used)).alias("duration_cv"),
        (120.0 / F.nullif(F.avg(used), F.lit(0.0))).alias("cadence"))


def segmentation_verdict(series: DataFrame, clip: str, side: str, fps: float) -> DataFrame:
    """Per clip: are both sides' cycles good enough, and if not, why.

    ``side`` holds 'L' and 'R'; a clip without one of them fails on that side.
    """
    keys = [clip, side]
    filled = fill_short_gaps(series, keys, fps).select(*keys, "frame", "value", "filled")
    raw_swing = swing(filled, keys).select(*keys, "amplitude")
    ev = hysteresis_events(filled.select(*keys, "frame", F.col("filled").alias("value")), keys)
    per_side = (join_same(raw_swing, cycle_summary(cycles(ev, keys, fps), keys), keys, "left")
                .na.fill({"n_cycles": 0, "n_used": 0}))

    def of(s: str, column: str) -> Column:
        return F.max(F.when(F.col(side) == s, F.col(column)))

    wide = per_side.groupBy(clip).agg(*[
        of(s, c).alias(f"{c}_{s.lower()}") for s in ("L", "R")
        for c in ("n_cycles", "n_used", "amplitude", "plausible_share", "duration_cv")])
    reasons = []
    for s in ("l", "r"):
        reasons += [
            F.when(F.coalesce(F.col(f"n_used_{s}"), F.lit(0)) < MIN_CYCLES, F.lit(f"{s}: too few cycles")),
            F.when(F.coalesce(F.col(f"amplitude_{s}"), F.lit(0.0)) < MIN_SWING, F.lit(f"{s}: swing too small")),
            F.when(F.col(f"plausible_share_{s}") < MIN_PLAUSIBLE, F.lit(f"{s}: implausible cycles"))]
    gap = F.abs(F.coalesce(F.col("n_cycles_l"), F.lit(0)) - F.coalesce(F.col("n_cycles_r"), F.lit(0)))
    reasons.append(F.when(gap > MAX_COUNT_GAP, F.lit("sides disagree on the count")))
    return (wide.withColumn("reasons", F.array_compact(F.array(*reasons)))
            .withColumn("ok", F.size("reasons") == 0))


def dominant_period(series: DataFrame, keys: list[str], lo: int, hi: int) -> DataFrame:
    """The lag in ``[lo, hi]`` with the largest autocorrelation, first on ties.

    NULLs are dropped and positions closed up first. NULL when the series is flat or
    shorter than ``lo + 3``; lags stop two short of the series length.
    """
    kept = number_frames(series.filter(F.col("value").isNotNull()), keys, ["frame"], "_pos")
    stats = kept.groupBy(*keys).agg(F.avg("value").alias("_mean"), F.count(F.lit(1)).alias("_n"))
    centred = join_same(kept, stats, keys).withColumn("_v", F.col("value") - F.col("_mean"))
    halo = with_halo(centred.select(*keys, "_pos", "_v", "_n"), "_pos", hi)
    window = block_window(keys, "_pos")
    lags = list(range(lo, hi + 1))
    ahead = halo.select("*", *[(F.col("_v") * F.lead("_v", k).over(window)).alias(f"_l{k}") for k in lags])
    sums = (ahead.filter(~F.col("_halo")).groupBy(*keys)
            .agg(F.sum(F.col("_v") * F.col("_v")).alias("_power"), F.max("_n").alias("_n"),
                 *[F.sum(f"_l{k}").alias(f"_l{k}") for k in lags]))
    scored = F.array(*[
        F.when(F.lit(k) <= F.col("_n") - 2,
               F.struct(F.round(F.col(f"_l{k}") / F.col("_power"), 9).alias("r"), F.lit(-k).alias("k"))) for k in lags])
    usable = (F.col("_n") >= lo + 3) & (F.col("_power") >= 1e-18) & (F.least(F.lit(hi), F.col("_n") - 2) > lo)
    best = F.array_max(F.filter(scored, lambda s: s.isNotNull()))
    return sums.select(
        *keys, F.when(usable, (-best["k"]).cast("long")).alias("period"),
        F.when(usable, best["r"]).alias("strength"))


def peak_per_cycle(series: DataFrame, all_cycles: DataFrame, keys: list[str]) -> DataFrame:
    """Largest value in each cycle, both ends included."""
    spans = all_cycles.select(*keys, "cycle_id", "lo", (F.col("hi") + 1).alias("_end"))
    inside = interval_join(series.select(*keys, "frame", "value"), spans, keys, "frame", "lo", "_end")
    return inside.groupBy(*keys, "cycle_id").agg(F.max("value").alias("peak"))


def longest_run(series: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """The longest run of consecutive frames satisfying ``flag``, earliest on ties."""
    found = runs(cut(series, keys, ["frame"]), flag, "frame")
    return (found.groupBy(*keys)
            .agg(F.max(F.struct(F.col("n"), (-F.col("lo")).alias("neg_lo"), F.col("hi"))).alias("_best"))
            .select(*keys, (-F.col("_best")["neg_lo"]).alias("lo"), F.col("_best")["hi"].alias("hi"),
                    F.col("_best")["n"].alias("n")))


def uncovered_runs(series: DataFrame, spans: DataFrame, keys: list[str], min_frames: int) -> DataFrame:
    """Runs of at least ``min_frames`` frames that no span ``[lo, hi)`` covers."""
    covered = (interval_join(series.select(*keys, "frame"), spans.select(*keys, "lo", "hi"),
                             keys, "frame", "lo", "hi", "left_semi")
               .withColumn("_covered", F.lit(True)))
    marked = series.select(*keys, "frame").join(covered, [*keys, "frame"], "left")
    return (runs(cut(marked, keys, ["frame"]), F.col("_covered").isNull(), "frame")
            .filter(F.col("n") >= min_frames))


def speeds(points: DataFrame, keys: list[str], coords: list[str], hz: float) -> DataFrame:
    """Speed of each point by first difference; NULL on its first frame."""
    ordered = cut(points, keys, ["frame"])
    before = ordered.add(**{f"_p{i}": Neighbour(F.col(c)) for i, c in enumerate(coords)}).rows()
    square = sum(((F.col(c) - F.col(f"_p{i}")) * (F.col(c) - F.col(f"_p{i}"))
                  for i, c in enumerate(coords)), F.lit(0.0))
    return (before.withColumn("speed", F.sqrt(square) * hz)
            .drop(*[f"_p{i}" for i in range(len(coords))]))


def shifted(df: DataFrame, keys: list[str], columns: dict[str, str], offset: int) -> DataFrame:
    """Values ``offset`` frames ahead (behind when negative), without one-task windows."""
    halo = with_halo(df, "frame", abs(offset))
    window = block_window(keys, "frame")
    move = (lambda c: F.lead(c, offset)) if offset >= 0 else (lambda c: F.lag(c, -offset))
    return (halo.select("*", *[move(c).over(window).alias(name) for c, name in columns.items()])
            .filter(~F.col("_halo")).drop("_block", "_halo"))


def contacts(series: DataFrame, keys: list[str], bar: float, min_frames: int) -> DataFrame:
    """Complete runs with value above ``bar`` lasting at least ``min_frames``, in order.

    A run cut off by either end of the series has no onset or no release and is left
    out. ``next2`` is the onset two contacts later: a stride when contacts alternate.
    """
    ends = series.groupBy(*keys).agg(F.max("frame").alias("_last"))
    found = (join_same(runs(cut(series, keys, ["frame"]), F.col("value") > bar, "frame"), ends, keys)
             .filter((F.col("n") >= min_frames) & (F.col("lo") > 0) & (F.col("hi") < F.col("_last")))
             .drop("_last"))
    ordered = cut(found, keys, ["lo"]).add(contact_id=Index(), _next=Neighbour(F.col("lo"), backward=True))
    return ordered.add(next2=Neighbour(F.col("_next"), backward=True)).rows().drop("_next")


def stance_fraction(series: DataFrame, keys: list[str], bar: float, min_frames: int,
                    keep: tuple[float, float] = (0.15, 0.75)) -> DataFrame:
    """Median contact share of the stride, over strides with a plausible share."""
    share = contacts(series, keys, bar, min_frames).withColumn(
        "share", F.col("n") / F.nullif(F.col("next2") - F.col("lo"), F.lit(0)))
    kept = share.filter((F.col("share") > keep[0]) & (F.col("share") < keep[1]))
    medians = quantiles(kept, keys, "share", {"median_share": 0.5})
    return join_same(kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_strides")), medians, keys)


def zero_crossing_rate(series: DataFrame, keys: list[str]) -> DataFrame:
    """Sign changes of the mean-removed value, and cycles per frame (two changes each)."""
    means = series.groupBy(*keys).agg(F.avg("value").alias("_mean"), F.count("value").alias("n"))
    centred = (join_same(series.filter(F.col("value").isNotNull()), means, keys)
               .withColumn("_up", F.col("value") > F.col("_mean")))
    stepped = cut(centred, keys, ["frame"]).add(_was=Neighbour(F.col("_up"))).rows()
    return (stepped.groupBy(*keys)
            .agg(F.count_if(F.col("_up") != F.col("_was")).alias("crossings"), F.max("n").alias("n"))
            .withColumn("cycles_per_frame", F.col("crossings") / (2.0 * F.col("n"))))


def duty_fraction(maxima: DataFrame, minima: DataFrame, periods: DataFrame,
                  keys: list[str]) -> DataFrame:
    """For each maximum: frames to the first later minimum, over the dominant period."""
    # At one frame the minimum sorts first, so only a strictly later one is found.
    both = (maxima.select(*keys, "frame", F.lit(1).alias("kind"))
            .unionByName(minima.select(*keys, "frame", F.lit(0).alias("kind"))))
    later = cut(both, keys, ["frame", "kind"]).add(
        next_min=Known(F.when(F.col("kind") == 0, F.col("frame")), backward=True)).rows()
    return (join_same(later.filter("kind = 1 and next_min is not null"),
                      periods.filter(F.col("period").isNotNull()).select(*keys, "period"), keys)
            .select(*keys, "frame", "next_min",
                    ((F.col("next_min") - F.col("frame")) / F.col("period")).alias("duty")))


def lag_scan(series: DataFrame, keys: list[str], x: str, y: str, reach: int,
             advantage: float = 0.15) -> DataFrame:
    """Correlation of ``x`` with ``y`` shifted by each lag; shift only if clearly better.

    Best by |r|, smallest lag on ties; the lag is 0 unless it beats lag 0 by ``advantage``.
    """
    halo = with_halo(series, "frame", reach)
    window = block_window(keys, "frame")
    lags = range(-reach, reach + 1)
    moved = halo.select("*", *[
        (F.lead(y, k) if k >= 0 else F.lag(y, -k)).over(window).alias(f"_y{i}") for i, k in enumerate(lags)])
    moved = moved.filter(~F.col("_halo"))
    scored = moved.groupBy(*keys).agg(*[
        F.round(correlation(F.col(x), F.col(f"_y{i}")), 9).alias(f"_r{i}") for i, _ in enumerate(lags)])
    entries = F.filter(F.array(*[
        F.struct(F.abs(F.col(f"_r{i}")).alias("a"), F.lit(-k).alias("k"), F.col(f"_r{i}").alias("r"))
        for i, k in enumerate(lags)]), lambda s: s["r"].isNotNull())
    best = F.array_max(entries)
    zero = F.col(f"_r{reach}")
    wins = best["a"] - F.coalesce(F.abs(zero), F.lit(0.0)) >= advantage
    return scored.select(
        *keys, (-best["k"]).cast("long").alias("best_lag"), best["r"].alias("best_r"), zero.alias("r0"),
        F.when(wins, -best["k"]).otherwise(0).cast("long").alias("used_lag"))


def nearest_label(runs_: DataFrame, spans: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The label of the span whose start lies closest to each run's end, earlier on ties."""
    end = F.col("hi") + 1
    marks = (runs_.select(*keys, end.alias("_at"), F.lit(1).alias("_kind"), "lo", "hi",
                          F.lit(None).cast(spans.schema[label].dataType).alias(label))
             .unionByName(spans.select(*keys, F.col("lo").alias("_at"), F.lit(0).alias("_kind"),
                                       F.lit(None).cast("long").alias("lo"),
                                       F.lit(None).cast("long").alias("hi"), label)))
    mark = F.when(F.col("_kind") == 0, F.struct("_at", label))
    seen = cut(marks, keys, ["_at", "_kind"]).add(
        _before=Known(mark), _after=Known(mark, backward=True)).rows().filter("_kind = 1")
    back = F.col("_at") - F.col("_before")["_at"]
    ahead = F.col("_after")["_at"] - F.col("_at")
    pick = F.when(F.col("_after").isNull() | (back <= ahead), F.col("_before")[label]).otherwise(
        F.col("_after")[label])
    return seen.select(*keys, "lo", "hi", pick.alias(f"nearest_{label}"))


def nearest_ticks(length: DataFrame, keys: list[str], source_hz: float, target_hz: float) -> DataFrame:
    """Source frames closest to the ticks of a lower rate, half-even, each once."""
    step = source_hz / target_hz
    last = F.col("n_frames") - 1
    ticks = F.sequence(F.lit(0).cast("long"), F.floor(last / step).cast("long"))
    picked = F.array_distinct(F.transform(ticks, lambda k: F.rint(k * step).cast("long")))
    return (length.select(*keys, last.alias("_last"), F.explode(picked).alias("frame"))
            .filter(F.col("frame") <= F.col("_last")).drop("_last"))


def centre_window(series: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The middle ``width`` frames of each group, or all of a shorter one."""
    sizes = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    lo = F.when(F.col("_n") <= width, F.lit(0)).otherwise(F.floor((F.col("_n") - width) / 2))
    return (join_same(series, sizes, keys)
            .filter((F.col("frame") >= lo) & (F.col("frame") < lo + width)).drop("_n"))
