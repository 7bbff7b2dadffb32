"""Curves held as arrays: resampling, smoothing and reconstruction per row.

A curve is one bounded array (a time-normalised cycle), so these are row expressions
and never shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempograin.functions.numeric import portable_hash


def grid(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def _lerp(curve: Column, x: Column) -> Column:
    lo = F.least(F.floor(x), F.size(curve) - 1).cast("int")
    hi = F.least(lo + 1, F.size(curve) - 1)
    a, b = F.get(curve, lo), F.get(curve, hi)
    return a + (b - a) * (x - lo)


def resample(curve: Column, n: int, fraction: float = 1.0) -> Column:
    """Linear resampling of the first ``fraction`` of a curve to ``n`` even points."""
    step = (F.size(curve) - 1) * (fraction / (n - 1))
    return F.transform(grid(n), lambda i: _lerp(curve, i * step))


def resample_known(points: Column, lo: Column, hi: Column, n: int) -> Column:
    """Resample (frame, value) pairs sorted by frame to ``n`` points over [lo, hi].

    Frames and borders are whole numbers. Gaps are bridged, the ends are held, and fewer than two points give NULL.
    Each stretch between two pairs makes its own part of the grid, so the work is grid plus pairs, not their product.
    """
    def first(p: Column) -> Column:
        """The first grid point that is not before a pair."""
        inside = F.ceil((p["frame"] - lo) * (n - 1) / F.nullif((hi - lo).cast("double"), F.lit(0.0)))
        held = F.coalesce(inside, F.when(p["frame"] > lo, F.lit(n)).otherwise(F.lit(0)))
        return F.least(F.greatest(held, F.lit(0)), F.lit(n)).cast("int")

    def stretch(p: Column, j: Column) -> Column:
        after = F.get(points, j + 1)
        start, end = first(p), F.when(after.isNull(), F.lit(n)).otherwise(first(after))
        span = (after["frame"] - p["frame"]).cast("double")

        def at(i: Column) -> Column:
            x = lo + (hi - lo) * i / float(n - 1)
            return F.when(after.isNull(), p["value"]).otherwise(
                p["value"] + (after["value"] - p["value"]) * (x - p["frame"]) / F.nullif(span, F.lit(0.0)))
        none = F.array().cast("array<double>")
        return F.when(start < end, F.transform(F.sequence(start, end - 1), at)).otherwise(none)
    lead = F.get(points, F.lit(0))
    return F.when(F.size(points) >= 2, F.concat(
        F.array_repeat(lead["value"], first(lead)), F.flatten(F.transform(points, stretch))))


def kernel(sigma: float) -> list[float]:
    """Gaussian weights out to four sigma, summing to one."""
    reach = int(4.0 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    total = sum(raw)
    return [w / total for w in raw]


def cutoff_sigma(fps: float, cutoff_hz: float) -> float:
    """Width in frames of the Gaussian with this -3 dB style cutoff."""
    return fps / (2.0 * math.pi * cutoff_hz)


def smooth(curve: Column, sigma: float) -> Column:
    """Gaussian low-pass with the ends held; a width of 0.3 or less changes nothing."""
    if sigma <= 0.3:
        return curve
    weights = kernel(sigma)
    reach = len(weights) // 2
    last = F.size(curve) - 1

    def at(i: Column) -> Column:
        terms = [F.get(curve, F.greatest(F.lit(0), F.least(i + (k - reach), last))) * w
                 for k, w in enumerate(weights)]
        return sum(terms[1:], terms[0])
    return F.transform(F.sequence(F.lit(0), last), at)


def pchip_slopes(y: Column) -> Column:
    """Slopes (per sample) of the monotone cubic through evenly spaced values."""
    last = F.size(y) - 1
    m = F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.get(y, i + 1) - F.get(y, i))

    def end(m0: Column, m1: Column) -> Column:
        d = (3.0 * m0 - m1) / 2.0
        return (F.when(F.signum(d) != F.signum(m0), 0.0)
                .when((F.signum(m0) != F.signum(m1)) & (F.abs(d) > 3.0 * F.abs(m0)), 3.0 * m0).otherwise(d))

    def at(i: Column) -> Column:
        a, b = F.get(m, i - 1), F.get(m, i)
        inner = F.when(a * b <= 0, 0.0).otherwise(2.0 * a * b / F.nullif(a + b, F.lit(0.0)))
        return (F.when(i == 0, end(F.get(m, F.lit(0)), F.get(m, F.lit(1))))
                .when(i == last, end(F.get(m, last - 1), F.get(m, last - 2))).otherwise(inner))
    return F.transform(F.sequence(F.lit(0), last), at)


def pchip(y: Column, slopes: Column, n: int) -> Column:
    """Monotone cubic reconstruction at ``n`` even points, given :func:`pchip_slopes`."""
    last = F.size(y) - 1

    def at(i: Column) -> Column:
        x = last * i / float(n - 1)
        k = F.least(F.floor(x), last - 1).cast("int")
        s = x - k
        y0, y1, d0, d1 = F.get(y, k), F.get(y, k + 1), F.get(slopes, k), F.get(slopes, k + 1)
        return (y0 * (1 + 2 * s) * (1 - s) * (1 - s) + d0 * s * (1 - s) * (1 - s)
                + y1 * s * s * (3 - 2 * s) + d1 * s * s * (s - 1))
    return F.transform(grid(n), at)


def gaussian_noise(seed: int, key: Column, i: Column) -> Column:
    """A standard normal draw that depends only on seed, key and position."""
    u1 = (portable_hash(F.lit(seed), key, i, F.lit("a")) + 0.5) / float(2 ** 32)
    u2 = (portable_hash(F.lit(seed), key, i, F.lit("b")) + 0.5) / float(2 ** 32)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def add_noise(curve: Column, sigma: float, seed: int, key: Column) -> Column:
    return F.transform(curve, lambda v, i: v + sigma * gaussian_noise(seed, key, i))
