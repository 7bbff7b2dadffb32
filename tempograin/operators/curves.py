"""Operators on tables of curves: bands, contrasts, conventions and perturbation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograin.functions import arrays
from tempograin.functions.numeric import correlation, portable_hash
from tempograin.operators.ordered import (
    Index, Neighbour, RunningSum, block_window, cut, join_same, quantiles, with_halo)


def long_curves(df: DataFrame, keys: list[str], curve: str) -> DataFrame:
    """One row per curve point: keys, ``t`` and ``value``."""
    return df.select(*keys, F.posexplode(curve).alias("t", "value")).withColumn("value", F.col("value").cast("double"))


def curve_band(long: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, sample SD (0 for a single curve) and size at each point."""
    spread = F.coalesce(F.stddev_samp("value"), F.when(F.count("value") == 1, F.lit(0.0)))
    return long.groupBy(*keys, "t").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), spread.alias("sd"))


def curve_quantiles(long: DataFrame, keys: list[str]) -> DataFrame:
    """Quartile curves across steps, at each point."""
    return quantiles(long, [*keys, "t"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def order_violations(bands: DataFrame, slack: float = 1e-4) -> DataFrame:
    """How many points break q25 <= q50 <= q75."""
    bad = (F.col("q25") > F.col("q50") + slack) | (F.col("q50") > F.col("q75") + slack)
    return bands.agg(F.count(F.lit(1)).alias("n_points"), F.count_if(bad).alias("n_violations"))


def both_sides(long: DataFrame, keys: list[str], side: str = "side") -> DataFrame:
    """Left and right mean at each point as two columns, where both exist."""
    wide = long.groupBy(*keys, "t").agg(
        F.avg(F.when(F.col(side) == "L", F.col("value"))).alias("l"),
        F.avg(F.when(F.col(side) == "R", F.col("value"))).alias("r"))
    return wide.filter("l is not null and r is not null")


def mirror_signs(sides: DataFrame, unit: list[str], channel: list[str], min_units: int = 30) -> DataFrame:
    """Per channel, whether left and right share a sign: the sign of their correlation.

    Units (sessions) are first averaged over the curve. With ``min_units`` or fewer, or
    a flat side, r counts as 0 and the sign as shared.
    """
    per_unit = sides.groupBy(*unit, *channel).agg(F.avg("l").alias("_l"), F.avg("r").alias("_r"))
    r = correlation(F.col("_l"), F.col("_r"))
    scored = per_unit.groupBy(*channel).agg(F.count(F.lit(1)).alias("n"), r.alias("_raw"))
    used = F.when(F.col("n") > min_units, F.coalesce("_raw", F.lit(0.0))).otherwise(0.0)
    return scored.select(*channel, "n", used.alias("r")).withColumn(
        "sign", F.when(F.round("r", 9) >= 0, 1).otherwise(-1))


def assert_signs(signs: DataFrame, channel: str, expected: dict) -> DataFrame:
    """The sign table, raising when a channel disagrees with its expected sign."""
    pairs = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    want = F.element_at(pairs, F.col(channel))
    return signs.withColumn("as_expected", F.when(want.isNull() | (F.col("sign") == want), True).otherwise(
        F.raise_error(F.concat(F.lit("unexpected sign convention in channel "), F.col(channel).cast("string")))))


def side_difference(sides: DataFrame, signs: DataFrame, channel: list[str]) -> DataFrame:
    """|l - r| and the sign-corrected r - s*l at each point."""
    return (sides.join(signs.select(*channel, "sign"), channel)
            .withColumn("asym", F.abs(F.col("l") - F.col("r")))
            .withColumn("d", F.col("r") - F.col("sign") * F.col("l")))


def wasserstein(df: DataFrame, keys: list[str], side: str, value: str) -> DataFrame:
    """1-D Wasserstein distance between the 'L' and 'R' samples of each group.

    Values are counted first; the area between the two cumulative curves then needs
    only running counts and the next distinct value.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count_if(F.col(side) == "L").alias("_nl"), F.count_if(F.col(side) == "R").alias("_nr"))
    totals = counts.groupBy(*keys).agg(F.sum("_nl").alias("_tl"), F.sum("_nr").alias("_tr"))
    steps = cut(counts, keys, [value]).add(
        _cl=RunningSum(F.col("_nl")), _cr=RunningSum(F.col("_nr")),
        _next=Neighbour(F.col(value), backward=True)).rows()
    area = F.abs(F.col("_cl") / F.nullif(F.col("_tl"), F.lit(0)) - F.col("_cr") / F.nullif(F.col("_tr"), F.lit(0)))
    return (join_same(steps, totals, keys).groupBy(*keys)
            .agg(F.sum(area * (F.col("_next") - F.col(value))).alias("_w"), F.max("_tl").alias("n_l"), F.max("_tr").alias("n_r"))
            .select(*keys, "n_l", "n_r", F.when((F.col("n_l") > 0) & (F.col("n_r") > 0),
                                                F.coalesce("_w", F.lit(0.0))).alias("wasserstein")))


def stride_contrasts(long: DataFrame, keys: list[str], step: str, side: str, edges: list[int],
                     min_steps: int = 3) -> DataFrame:
    """Right minus left over blocks of the curve: mean, median, SD (ddof 0), IQR, distance.

    Each stride is first averaged inside the block, then strides are compared as two
    samples; NULL where either side has fewer than ``min_steps``.
    """
    block = F.lit(None).cast("int")
    for b in range(len(edges) - 2, -1, -1):
        block = F.when((F.col("t") >= edges[b]) & (F.col("t") < edges[b + 1]), b).otherwise(block)
    values = (long.withColumn("block", block).filter(F.col("block").isNotNull())
              .groupBy(*keys, side, step, "block").agg(F.avg("value").alias("_v")))
    cell = [*keys, "block"]
    moments = values.groupBy(*cell, side).agg(
        F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("sd"))
    quart = quantiles(values, [*cell, side], "_v", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    table = moments.join(quart, [*cell, side])

    def of(s: str, c: str) -> Column:
        return F.max(F.when(F.col(side) == s, F.col(c)))
    wide = table.groupBy(*cell).agg(*[
        of(s, c).alias(f"{c}_{s}") for s in ("L", "R") for c in ("n", "mean", "sd", "q25", "q50", "q75")])
    enough = (F.coalesce("n_L", F.lit(0)) >= min_steps) & (F.coalesce("n_R", F.lit(0)) >= min_steps)
    distance = wasserstein(values, cell, side, "_v").select(*cell, "wasserstein")

    def when(value: Column, name: str) -> Column:
        return F.when(enough, value).alias(name)
    return wide.join(distance, cell).select(
        *cell, when(F.col("mean_R") - F.col("mean_L"), "d_mean"), when(F.col("q50_R") - F.col("q50_L"), "d_median"),
        when(F.col("sd_R") - F.col("sd_L"), "d_sd"),
        when((F.col("q75_R") - F.col("q25_R")) - (F.col("q75_L") - F.col("q25_L")), "d_iqr"),
        when(F.col("wasserstein"), "wasserstein"))


def normalise_cycles(inside: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Each cycle as ``n`` points; the rows are a cycle's frames with its ``lo`` and ``hi``.

    Only plausible cycles belong here: their length is bounded by the duration filter.
    """
    point = F.when(F.col("value").isNotNull(), F.struct("frame", "value"))
    points = inside.groupBy(*keys, "lo", "hi").agg(F.sort_array(F.collect_list(point)).alias("_points"))
    return points.select(*keys, arrays.resample_known(F.col("_points"), F.col("lo"), F.col("hi"), n).alias("curve"))


def compare_curves(pairs: DataFrame, keys: list[str], joint: str) -> DataFrame:
    """Agreement of two curves per key, and centred RMS under one sign per joint.

    ``pairs`` is long with ``ours`` and ``theirs``. The sign comes from the median
    correlation over the joint's curves, never from a single curve.
    """
    stats = pairs.groupBy(*keys, joint).agg(
        correlation(F.col("ours"), F.col("theirs")).alias("r"),
        (F.avg("ours") - F.avg("theirs")).alias("offset"),
        F.avg("ours").alias("_mo"), F.avg("theirs").alias("_mt"),
        (F.max("ours") - F.min("ours")).alias("range_ours"), (F.max("theirs") - F.min("theirs")).alias("range_theirs"))
    middle = quantiles(stats, [joint], "r", {"_median": 0.5})
    signed = stats.join(middle, joint).withColumn("sign", F.when(F.col("_median") < 0, -1).otherwise(1))
    gap = F.col("sign") * (F.col("ours") - F.col("_mo")) - (F.col("theirs") - F.col("_mt"))
    rms = (pairs.join(signed.select(*keys, joint, "sign", "_mo", "_mt"), [*keys, joint])
           .groupBy(*keys, joint).agg(F.sqrt(F.avg(gap * gap)).alias("rms")))
    return signed.join(rms, [*keys, joint]).select(
        *keys, joint, "r", "offset", "range_ours", "range_theirs",
        (F.col("range_ours") / F.nullif(F.col("range_theirs"), F.lit(0.0))).alias("amp_ratio"), "sign", "rms")


def smooth_series(series: DataFrame, keys: list[str], value: str, sigma: float, name: str = "smooth") -> DataFrame:
    """Gaussian low-pass of a long series of any length, ends held.

    The kernel reaches a few rows each way, so blocks with a halo are enough.
    """
    if sigma <= 0.3:
        return series.withColumn(name, F.col(value))
    weights = arrays.kernel(sigma)
    reach = len(weights) // 2
    ends = series.groupBy(*keys).agg(F.min_by(value, "frame").alias("_head"), F.max_by(value, "frame").alias("_tail"))
    window = block_window(keys, "frame")
    halo = with_halo(series.join(ends, keys), "frame", reach)
    terms = []
    for i, w in enumerate(weights):
        k = i - reach
        near = F.col(value) if k == 0 else (F.lead(value, k) if k > 0 else F.lag(value, -k)).over(window)
        edge = F.col("_tail") if k > 0 else F.col("_head")
        terms.append(F.coalesce(near, edge) * w)
    return (halo.withColumn(name, sum(terms[1:], terms[0])).filter(~F.col("_halo"))
            .drop("_halo", "_block", "_head", "_tail"))


def degrade(df: DataFrame, key: str, curve: str, k: int, sigma: float, seconds: float,
            seed: int, n: int, cutoff_hz: float = 10.0) -> DataFrame:
    """A curve as a camera taking ``k`` frames would have seen it.

    Decimate, add noise, low-pass at the acquired rate, rebuild monotonically.
    """
    steps = df.withColumn("_s", arrays.resample(F.transform(F.col(curve), lambda v: v.cast("double")), k))
    if sigma > 0:
        steps = steps.withColumn("_s", arrays.add_noise(F.col("_s"), sigma, seed, F.col(key)))
        if k >= 5:
            steps = steps.withColumn("_s", arrays.smooth(F.col("_s"), arrays.cutoff_sigma(k / max(seconds, 1e-3), cutoff_hz)))
    if k > 3:
        steps = steps.withColumn("_d", arrays.pchip_slopes(F.col("_s")))
        rebuilt = arrays.pchip(F.col("_s"), F.col("_d"), n)
    else:
        rebuilt = arrays.resample(F.col("_s"), n)
    return steps.withColumn("degraded", rebuilt).drop("_s", "_d")


def perturb_from_bank(pairs: DataFrame, bank: DataFrame, session: str, seed: int, scale: float = 1.0) -> DataFrame:
    """Add one bank clip's near and far residuals to each session's two sides.

    ``pairs`` holds ``l`` and ``r`` curves; ``bank`` holds ``near`` and ``far`` curves and
    a ``clip``. Which side is far is drawn per session.
    """
    numbered = cut(bank, [], ["clip"]).add(_i=Index()).rows().select("_i", "near", "far")
    size = bank.agg(F.count(F.lit(1))).scalar()
    drawn = pairs.withColumn("_i", F.pmod(portable_hash(F.lit(seed), F.col(session), F.lit("clip")), size)).withColumn(
        "_right_far", portable_hash(F.lit(seed), F.col(session), F.lit("far")) % 2 == 1)
    joined = drawn.join(numbered, "_i")

    def moved(side: str, error: Column) -> Column:
        return F.zip_with(side, error, lambda v, e: v + scale * e)
    left = moved("l", F.when(F.col("_right_far"), F.col("near")).otherwise(F.col("far")))
    right = moved("r", F.when(F.col("_right_far"), F.col("far")).otherwise(F.col("near")))
    return (joined.withColumn("l_moved", left).withColumn("r_moved", right)
            .withColumn("realised", (_mean_gap("l", "l_moved") + _mean_gap("r", "r_moved")) / 2.0)
            .drop("_i", "_right_far", "near", "far"))


def _mean_gap(a: str, b: str) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def random_side(subject: Column, seed: int) -> Column:
    """'R' or 'L' per subject: every session of a subject gets the same."""
    return F.when(portable_hash(subject, F.lit(seed)) % 2 == 1, "R").otherwise("L")


def inject(sides: DataFrame, chosen: Column, delta: float, profile: Column) -> DataFrame:
    """Add ``delta`` times a unit-peak profile to the chosen side, before differencing."""
    add = delta * profile
    return sides.withColumns({
        "r": F.col("r") + F.when(chosen == "R", add).otherwise(0.0),
        "l": F.col("l") + F.when(chosen == "L", add).otherwise(0.0)})


def bump(t: Column, n: int) -> Column:
    """Unit-peak bump centred at 40 % of the curve."""
    x = (t / float(n - 1) - 0.40) / 0.12
    return F.exp(-0.5 * x * x)


def wide_vector(long: DataFrame, keys: list[str]) -> DataFrame:
    """Channel means in channel order as one feature array per key; channels are few."""
    pairs = F.sort_array(F.collect_list(F.struct("channel", "value")))
    return long.groupBy(*keys).agg(pairs.alias("_p")).select(
        *keys, F.transform("_p", lambda p: p["value"]).alias("features"))
