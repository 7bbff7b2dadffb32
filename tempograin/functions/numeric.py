"""Numeric expressions shared by the operators."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r6(value: Column) -> Column:
    """Round for comparison across engines; the addition turns -0.0 into 0.0."""
    return F.round(value.cast("double"), 6) + F.lit(0.0)


def r6_scaled(value: Column) -> Column:
    """As :func:`r6`, but what is rounded is the double of a million times the value, as in DuckDB.

    Spark rounds the value's decimal digits. Where a value lies a last bit off a tie, its multiple may be the tie.
    """
    return F.round(value.cast("double") * 1e6, 0) / 1e6 + F.lit(0.0)


def ratio(top: Column, bottom: Column) -> Column:
    """Division that is NULL on a zero denominator."""
    return top / F.nullif(bottom.cast("double"), F.lit(0.0))


def known(value: Column) -> Column:
    """The value with NaN turned into NULL."""
    return F.when(F.isnan(value), F.lit(None).cast("double")).otherwise(value)


def wrap_degrees(angle: Column) -> Column:
    """An angle folded into [-180, 180)."""
    return F.pmod(angle + 180.0, F.lit(360.0)) - 180.0


def correlation(x: Column, y: Column) -> Column:
    """Pearson r as an aggregate; NULL when either side is flat or alone.

    Built on covariance and population SDs so a flat side gives NULL, not an error.
    """
    both = x.isNotNull() & y.isNotNull()
    sx = F.stddev_pop(F.when(both, x))
    sy = F.stddev_pop(F.when(both, y))
    flat = (sx < 1e-12) | (sy < 1e-12)
    return F.when(flat, F.lit(None).cast("double")).otherwise(
        F.covar_pop(x, y) / F.nullif(sx * sy, F.lit(0.0)))


def portable_hash(*parts: Column) -> Column:
    """A 32-bit hash any engine with MD5 can replay."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """A reproducible draw from (0, 1)."""
    return (portable_hash(*parts) + 0.5) / float(2 ** 32)


# Two odd multipliers and a prime: products of two 31-bit numbers stay in a 64-bit integer.
REPLICATE_PRIME = 2 ** 31 - 1
REPLICATE_MIX = (1597334677, 741103597)
# Draws up to each limit give 0, 1, 2, ... times the row: the Poisson(1) distribution.
REPLICATE_LIMITS = [int(REPLICATE_PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)))
                    for k in range(11)]


def resampled(df: DataFrame, unit: list[str], reps: int, seed: int) -> DataFrame:
    """``df`` once per replicate ``rep`` with the count ``w`` of its ``unit`` there; rows of count 0 are left out.

    Counts are Poisson(1), a function of (seed, unit, rep) alone. Nothing is drawn elsewhere
    and joined, so a sum per replicate is formed where the rows are.
    """
    x, (first, second) = F.col("_x"), REPLICATE_MIX
    steps = [x * (2 * F.col("rep") + 1) % REPLICATE_PRIME, x.bitwiseXOR(F.shiftright(x, 15)),
             x * first % REPLICATE_PRIME, x.bitwiseXOR(F.shiftright(x, 13)), x * second % REPLICATE_PRIME]
    out = df.withColumn("_x", replicate_start(unit, seed)).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    for step in steps:
        out = out.withColumn("_x", step)
    count = F.lit(len(REPLICATE_LIMITS))
    for k, limit in reversed(list(enumerate(REPLICATE_LIMITS))):
        count = F.when(x <= limit, k).otherwise(count)
    return out.filter(x > REPLICATE_LIMITS[0]).withColumn("w", count).drop("_x")


def replicate_start(unit: list[str], seed: int) -> Column:
    """The number from which a unit's counts in all replicates follow."""
    return F.pmod(portable_hash(F.lit(seed), *map(F.col, unit)), F.lit(REPLICATE_PRIME))


def replicate_counts(start: np.ndarray, reps: int) -> np.ndarray:
    """The counts of :func:`resampled` as a matrix, a row per start and a column per replicate."""
    x = start[:, None] * (2 * np.arange(1, reps + 1) + 1) % REPLICATE_PRIME
    x ^= x >> 15
    x = x * REPLICATE_MIX[0] % REPLICATE_PRIME
    x ^= x >> 13
    x = x * REPLICATE_MIX[1] % REPLICATE_PRIME
    return np.searchsorted(REPLICATE_LIMITS, x)


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal by its continued fraction and series.

    Spark has no erf. Below 3 the Taylor series of the integral converges in 60 terms;
    above, 40 levels of the continued fraction reach double precision.
    """
    a = F.abs(z)
    density = F.exp(-a * a / 2.0) / math.sqrt(2.0 * math.pi)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)),
        F.struct(a.alias("term"), a.alias("total")),
        lambda s, k: F.struct(
            (s["term"] * a * a / (2.0 * k + 1.0)).alias("term"),
            (s["total"] + s["term"] * a * a / (2.0 * k + 1.0)).alias("total")),
        lambda s: s["total"])
    fraction = F.aggregate(
        F.sequence(F.lit(40), F.lit(1), F.lit(-1)), F.lit(0.0),
        lambda s, k: k / (a + s))
    upper = F.when(a < 3.0, 0.5 - density * series).otherwise(density / (a + fraction))
    return F.when(z >= 0, upper).otherwise(1.0 - upper)
