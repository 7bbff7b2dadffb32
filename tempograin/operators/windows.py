"""Overlapping fixed-length windows with a user function, blended back per frame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempograin.operators.ordered import join_same


def triangle(length: int) -> list[float]:
    """Weights rising to the window's centre, never below 0.001."""
    return [max(1.0 - abs(-1.0 + 2.0 * i / (length - 1)), 1e-3) for i in range(length)]


def apply_windows(series: DataFrame, keys: list[str], value: str,
                  fn: Callable[[np.ndarray], np.ndarray], length: int, name: str = "blended") -> DataFrame:
    """Run ``fn`` on windows of ``length`` frames, half overlapping, and blend the results.

    ``fn`` takes and returns an array of shape (windows, length). The last window is
    moved back to end on the last frame; a short clip is padded with its last value.
    A window holds ``length`` values, so the collected arrays are bounded.
    """
    stride = length // 2
    sizes = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    last = F.greatest(F.col("_n") - length, F.lit(0))
    first_k = F.greatest(F.lit(0), F.ceil((F.col("frame") - (length - 1)) / stride))
    last_k = F.floor(F.least(F.col("frame"), last) / stride)
    regular = F.when(first_k <= last_k, F.transform(F.sequence(first_k, last_k), lambda k: k * stride))
    flush = F.when((last % stride != 0) & (F.col("frame") >= last), F.array(last.cast("long")))
    empty = F.array().cast("array<bigint>")
    starts = F.array_distinct(F.concat(F.coalesce(regular, empty), F.coalesce(flush, empty)))
    placed = (join_same(series.select(*keys, "frame", value), sizes, keys)
              .select(*keys, F.explode(starts).alias("_start"), (F.struct("frame", F.col(value).alias("v"))).alias("_p")))
    windows = placed.groupBy(*keys, "_start").agg(F.sort_array(F.collect_list("_p")).alias("_w"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(chunks: pd.Series) -> pd.Series:
        if len(chunks) == 0:
            return chunks
        padded = np.stack([np.pad(np.asarray(c, dtype=float), (0, length - len(c)), mode="edge") for c in chunks])
        got = fn(padded)
        return pd.Series([g[:len(c)] for g, c in zip(got, chunks)])

    done = windows.withColumn("_out", run(F.transform("_w", lambda p: p["v"])))
    weights = F.array(*[F.lit(w) for w in triangle(length)])
    flat = (done.select(*keys, "_start", F.posexplode("_out").alias("_i", "_v"))
            .withColumn("frame", F.col("_start") + F.col("_i")).withColumn("_t", F.get(weights, F.col("_i"))))
    return flat.groupBy(*keys, "frame").agg(
        (F.sum(F.col("_t") * F.col("_v")) / F.sum("_t")).alias(name), F.sum("_t").alias("weight"))
