"""Joins of the study: coverage, preference, pairing, matching and leak checks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograin.functions.numeric import ratio
from tempograin.session import durable

GRAM = 3  # characters of the parts by which names are looked up


def coverage_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Row counts of a left join that must not multiply rows; raises if it does."""
    marked = right.select(*keys).withColumn("_hit", F.lit(1))
    joined = left.select(*keys).join(marked, keys, "left").agg(
        F.count(F.lit(1)).alias("n_joined"), F.count("_hit").alias("n_matched"))
    size = left.agg(F.count(F.lit(1))).scalar()
    same = F.col("n_joined") == F.col("n_left")
    return joined.withColumn("n_left", size).select(
        "n_left", "n_joined", "n_matched",
        ratio(F.col("n_matched"), F.col("n_left")).alias("coverage"),
        F.when(same, True).otherwise(F.raise_error(F.lit("the join multiplied rows"))).alias("complete"))


def prefer_union(preferred: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """All of one side, plus the other side's rows whose key the first does not have."""
    rest = other.join(preferred.select(*keys), keys, "left_anti")
    return preferred.unionByName(rest, allowMissingColumns=True)


def length_matched(left: DataFrame, right: DataFrame, clip: list[str]) -> DataFrame:
    """Clips whose two sources have the same number of frames."""
    a = left.groupBy(*clip).agg(F.count(F.lit(1)).alias("n_frames"))
    b = right.groupBy(*clip).agg(F.count(F.lit(1)).alias("n_frames"))
    return a.join(b, [*clip, "n_frames"])


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """(_id, _name, _grams) of the distinct names that are not empty: their parts of one to GRAM characters."""
    parts = F.array_distinct(F.concat(*[F.regexp_extract_all("_name", F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)) for q in range(1, GRAM + 1)]))
    names = df.select(F.col(name).alias("_name")).filter(F.length("_name") > 0).distinct()
    return durable(names.select(F.monotonically_increasing_id().alias("_id"), "_name")).withColumn("_grams", parts)


def _held(needles: DataFrame, holders: DataFrame) -> DataFrame:
    """(needle, holder) numbers of each name of ``needles`` that a name of ``holders`` contains.

    The index lists the holders of each gram. A needle is looked up by the gram of its own
    that the fewest holders have, and then compared.
    """
    index = durable(holders.select(F.col("_id").alias("holder"), F.explode("_grams").alias("_gram")))
    sizes = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("_holders"))
    longest = F.least(F.length("_name"), F.lit(GRAM))
    own = needles.select(F.col("_id").alias("needle"), F.explode(F.filter("_grams", lambda g: F.length(g) == longest)).alias("_gram"))
    looked_up = own.join(sizes, "_gram").groupBy("needle").agg(F.min(F.struct("_holders", "_gram")).alias("_rarest"))
    found = looked_up.select("needle", F.col("_rarest._gram").alias("_gram")).join(index, "_gram").select("needle", "holder")
    inner = needles.select(F.col("_id").alias("needle"), F.col("_name").alias("_part"))
    outer = holders.select(F.col("_id").alias("holder"), F.col("_name").alias("_whole"))
    return found.join(inner, "needle").join(outer, "holder").filter(F.contains("_whole", "_part"))


def contained_name(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """For each left name, the first right name (sorted) that contains or is contained in it.

    Names are found through an index of short grams, so a name costs its length; null and
    empty names match nothing. Left names without a match have no row.
    """
    names, others = _numbered(left, left_name), _numbered(right, right_name)
    inside = _held(names, others).select(F.col("_part").alias(left_name), F.col("_whole").alias("_hit"))
    around = _held(others, names).select(F.col("_whole").alias(left_name), F.col("_part").alias("_hit"))
    return inside.unionByName(around).groupBy(left_name).agg(F.min("_hit").alias(right_name))


def grid(df: DataFrame, **levels: list) -> DataFrame:
    """Every row once per combination of the literal levels."""
    def arrays(items: list) -> Column:
        return F.array(*[F.lit(v) for v in items])
    return reduce(lambda d, kv: d.withColumn(kv[0], F.explode(arrays(kv[1]))), levels.items(), df)


def leaking_groups(folds: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Per fold, how many groups sit in both train and test."""
    both = folds.groupBy(*keys, group).agg(
        F.max((F.col("role") == "train").cast("int")).alias("_tr"),
        F.max((F.col("role") == "test").cast("int")).alias("_te"))
    return both.groupBy(*keys).agg(F.count_if((F.col("_tr") == 1) & (F.col("_te") == 1)).alias("n_leaking"))


def require_no_leak(folds: DataFrame, keys: list[str], group: str) -> DataFrame:
    """The leak report, raising when any group leaks."""
    return leaking_groups(folds, keys, group).withColumn(
        "clean", F.when(F.col("n_leaking") == 0, True).otherwise(
            F.raise_error(F.lit("a group sits in both train and test"))))


# Vectors of one cell that a task compares at a time, and the pairs of a cell that are not worth it.
BLOCK_ROWS = 8192
FEW_PAIRS = 4096


def _nearest_in_block(left: pd.DataFrame, right: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    """(k, d, other): each left vector's nearest right one and its distance, if within ``tolerance``."""
    if left.empty or right.empty:
        return pd.DataFrame({"k": [], "d": [], "other": []})
    a, b = (np.stack(df["v"].to_numpy()).astype(float) for df in (left, right))
    order = np.argsort(right["k"].to_numpy(), kind="stable")
    b, others = b[order], right["k"].to_numpy()[order]
    squares = (b * b).sum(axis=1)
    kept = []
    for first in range(0, len(a), 512):
        part = a[first:first + 512]
        rough = (part * part).sum(axis=1)[:, None] + squares - 2 * part @ b.T
        # The product is off by rounding: whatever may be the nearest is measured again.
        slack = 1e-11 * ((part * part).sum(axis=1) + squares.max())
        limit = np.minimum(rough.min(axis=1) + slack, tolerance * tolerance * (1 + 1e-11) + slack)
        i, j = np.nonzero(rough <= limit[:, None])
        d = np.zeros(len(i))
        for x, y in zip(part.T, b.T):
            d += (x[i] - y[j]) ** 2
        d = np.sqrt(d)
        # By left vector, distance and id; the first of each left vector.
        best = np.lexsort((j, d, i))
        best = best[np.flatnonzero(np.diff(i[best], prepend=-1))]
        best = best[d[best] <= tolerance]
        kept.append(pd.DataFrame({"k": left["k"].to_numpy()[first + i[best]], "d": d[best], "other": others[j[best]]}))
    return pd.concat(kept)


def match_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, vector: str,
                 tolerance: float, axes: list[list[float]]) -> DataFrame:
    """Nearest right vector for each left vector, if within ``tolerance`` (exact).

    The projection of two vectors on a unit axis differs by no more than their distance,
    so candidates are looked up in neighbouring cells along each axis. Vectors of a large
    cell are compared block by block as matrix products, which never become rows.
    Identical vectors are matched once, through their smallest id; those with unknown numbers match nothing.
    """
    names = [f"_c{i}" for i in range(len(axes))]

    def projected(df: DataFrame, key: str) -> DataFrame:
        unique = df.groupBy(vector).agg(F.min(key).alias("k")).withColumnRenamed(vector, "v")
        dots = [F.aggregate(F.zip_with("v", F.array(*[F.lit(float(a)) for a in axis]),
                                       lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
                for axis in axes]
        known = unique.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
        return known.select("k", F.col("v").cast("array<double>").alias("v"), F.array(*[F.floor(d / tolerance) for d in dots]).alias("_cell"))

    sources = durable(projected(left, left_id))
    cells = sources
    for i, name in enumerate(names):
        cells = cells.withColumn(name, F.explode(F.sequence(F.col("_cell")[i] - 1, F.col("_cell")[i] + 1)))
    cells = cells.select("k", "v", *names)
    targets = durable(projected(right, right_id).select("k", "v", *[F.col("_cell")[i].alias(c) for i, c in enumerate(names)]))
    counts = (F.count(F.lit(1)).alias(n) for n in ("_l", "_r"))
    sizes = durable(cells.groupBy(*names).agg(next(counts)).join(targets.groupBy(*names).agg(next(counts)), names))
    few = sizes.filter(F.col("_l") * F.col("_r") <= FEW_PAIRS).select(*names)
    many = sizes.filter(F.col("_l") * F.col("_r") > FEW_PAIRS)

    gaps = F.zip_with("v", "_v", lambda x, y: x - y)
    distance = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, d: s + d * d))
    paired = (cells.join(few, names).join(targets.select(F.col("k").alias("other"), F.col("v").alias("_v"), *names), names)
              .select("k", distance.alias("d"), "other").filter(F.col("d") <= tolerance))

    # Every block of a cell's left vectors meets every block of its right ones.
    blocks = [F.ceil(F.col(c) / F.lit(BLOCK_ROWS)) for c in ("_l", "_r")]
    mine = [F.pmod(F.xxhash64("k"), n) for n in blocks]
    every = [F.explode(F.sequence(F.lit(0).cast("long"), n - 1)) for n in blocks]
    place = [*names, "_i", "_j"]
    lefts = cells.join(many, names).withColumn("_i", mine[0]).withColumn("_j", every[1]).select("k", "v", *place)
    rights = targets.join(many, names).withColumn("_j", mine[1]).withColumn("_i", every[0]).select("k", "v", *place)
    kinds = [sources.schema["k"].dataType.simpleString(), targets.schema["k"].dataType.simpleString()]
    compared = lefts.groupBy(*place).cogroup(rights.groupBy(*place)).applyInPandas(
        lambda a, b: _nearest_in_block(a, b, tolerance), f"k {kinds[0]}, d double, other {kinds[1]}")
    best = paired.unionByName(compared).groupBy("k").agg(F.min(F.struct("d", "other")).alias("_b"))
    found = sources.join(best, "k").select(F.col("v").alias("_v"), "_b")
    return (left.join(found, F.col(vector).cast("array<double>") == F.col("_v"))
            .select(left_id, F.col("_b")["other"].alias(right_id), F.col("_b")["d"].alias("distance")))
