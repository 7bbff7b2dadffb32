"""Ordered computations per group that survive one group holding most of the rows.

A window partitioned by a group key sends the whole group to one task. Here the rows are
first cut into chunks by ranges of all order columns, windows run per (group, chunk), and
a much smaller table with one row per (group, chunk) carries the state across chunk
borders. Small inputs skip the cut and use the ordinary window.

The result is the same whatever the cut: each row's chunk is written with it, so a
recomputed task sees the same chunks. Chunks follow Spark's own sort order, so order
columns may be of any sortable type, null or NaN, and group keys may be null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograin import session

CHUNK = "_chunk"
GROUP = "_group"  # the group keys as one value, in which nulls are equal


@dataclass(frozen=True)
class Index:
    """0-based position in the group's order."""


@dataclass(frozen=True)
class RunningSum:
    """Sum from the group's first row to this one."""
    value: Column


@dataclass(frozen=True)
class RunningMin:
    """Smallest value from the group's first row to this one (or this to the last)."""
    value: Column
    backward: bool = False


@dataclass(frozen=True)
class RunningMax:
    """Largest value from the group's first row to this one (or this to the last)."""
    value: Column
    backward: bool = False


@dataclass(frozen=True)
class Known:
    """Nearest non-null value at or before this row (or at or after it)."""
    value: Column
    backward: bool = False


@dataclass(frozen=True)
class Neighbour:
    """The value one row before this one (or one row after it)."""
    value: Column
    backward: bool = False


@dataclass
class Ordered:
    """Rows with a total order inside each group; nulls come first, as in any sort."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    chunked: bool = field(default=False)

    def add(self, **specs) -> "Ordered":
        """Add one column per spec, all in the same pass over the rows."""
        if not self.chunked:
            forward, backward = self._windows(self.keys, self.order)
            columns = {name: _local(spec, forward, backward) for name, spec in specs.items()}
            return Ordered(self.df.withColumns(columns), self.keys, self.order)
        return self._add_across_chunks(specs)

    def _windows(self, keys, order):
        part = Window.partitionBy(*keys)
        return (part.orderBy(*[F.col(c).asc() for c in order]),
                part.orderBy(*[F.col(c).desc() for c in order]))

    def _add_across_chunks(self, specs) -> "Ordered":
        group = [GROUP] if self.keys else []
        cell = [*group, CHUNK]
        forward, backward = self._windows(cell, self.order)
        local = {name: _local(spec, forward, backward) for name, spec in specs.items()}
        local["_first"] = F.row_number().over(forward) == 1
        if any(isinstance(s, Neighbour) and s.backward for s in specs.values()):
            local["_last"] = F.row_number().over(backward) == 1
        position = F.struct(*self.order)
        summaries = self.df.groupBy(*cell).agg(
            *[_summary(spec, position).alias(f"_s_{name}") for name, spec in specs.items()])
        over_chunks, over_chunks_back = self._windows(group, [CHUNK])
        carries = summaries.select(*cell, *[
            _carry(spec, F.col(f"_s_{name}"), over_chunks, over_chunks_back).alias(f"_c_{name}")
            for name, spec in specs.items()])
        joined = self.df.withColumns(local).join(carries, cell)
        out = joined.select(
            *self.df.columns,
            *[_combine(spec, F.col(name), F.col(f"_c_{name}")).alias(name)
              for name, spec in specs.items()])
        return Ordered(session.durable(out), self.keys, self.order, True)

    def rows(self) -> DataFrame:
        """The rows without the columns of the cut."""
        return self.df.drop(CHUNK, GROUP)


def _local(spec, forward, backward) -> Column:
    start, here = Window.unboundedPreceding, Window.currentRow
    if isinstance(spec, Index):
        return (F.row_number().over(forward) - 1).cast("long")
    window = backward if getattr(spec, "backward", False) else forward
    frame = window.rowsBetween(start, here)
    if isinstance(spec, RunningSum):
        return F.sum(spec.value).over(frame)
    if isinstance(spec, RunningMin):
        return F.min(spec.value).over(frame)
    if isinstance(spec, RunningMax):
        return F.max(spec.value).over(frame)
    if isinstance(spec, Known):
        return F.last(spec.value, ignorenulls=True).over(frame)
    return F.lag(spec.value, 1).over(window)


def _summary(spec, position: Column) -> Column:
    if isinstance(spec, Index):
        return F.count(F.lit(1))
    if isinstance(spec, RunningSum):
        return F.sum(spec.value)
    if isinstance(spec, RunningMin):
        return F.min(spec.value)
    if isinstance(spec, RunningMax):
        return F.max(spec.value)
    pick = F.min_by if spec.backward else F.max_by
    if isinstance(spec, Known):
        return pick(spec.value, F.when(spec.value.isNotNull(), position))
    return pick(spec.value, position)


def _carry(spec, summary: Column, forward, backward) -> Column:
    window = backward if getattr(spec, "backward", False) else forward
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    if isinstance(spec, (Index, RunningSum)):
        return F.sum(summary).over(before)
    if isinstance(spec, RunningMin):
        return F.min(summary).over(before)
    if isinstance(spec, RunningMax):
        return F.max(summary).over(before)
    if isinstance(spec, Known):
        return F.last(summary, ignorenulls=True).over(before)
    return F.lag(summary, 1).over(window)


def _combine(spec, local: Column, carry: Column) -> Column:
    if isinstance(spec, Index):
        return local + F.coalesce(carry, F.lit(0))
    if isinstance(spec, RunningSum):
        return F.coalesce(local + carry, local, carry)
    if isinstance(spec, RunningMin):
        return F.least(local, carry)
    if isinstance(spec, RunningMax):
        return F.greatest(local, carry)
    if isinstance(spec, Known):
        return F.coalesce(local, carry)
    edge = F.col("_last") if spec.backward else F.col("_first")
    return F.when(edge, carry).otherwise(local)


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, in which nulls are equal; the keys are those of ``left``."""
    named = right.select(*[F.col(k).alias(f"_same_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return left.join(named, condition, how).drop(*[f"_same_{k}" for k in keys])


def cut(df: DataFrame, keys: list[str], order: list[str]) -> Ordered:
    """Prepare ordered computations per ``keys``.

    A border may fall between any two rows whose order columns differ, so a value that
    many rows share in the first column is split by the others.
    """
    if session.surely_small(df):
        return Ordered(df, keys, order)
    size = session.rows_per_chunk(df.sparkSession) or session.DEFAULT_ROWS_PER_CHUNK
    base = session.durable(df)
    n = base.count()
    if n <= size:
        return Ordered(base, keys, order)
    ranged = base.repartitionByRange(-(-n // size), *order).withColumn(CHUNK, F.spark_partition_id())
    if keys:
        ranged = ranged.withColumn(GROUP, F.struct(*keys))
    return Ordered(session.durable(ranged), keys, order, True)


# ------------------------------------------------------------------ lookups in range

def with_halo(df: DataFrame, index: str, reach: int, block: int = 100_000) -> DataFrame:
    """Copy the rows within ``reach`` of a block border into the neighbouring block.

    Adds ``_block`` and ``_halo``. A window over (keys, ``_block``) then answers lag and
    lead up to ``reach`` for rows with ``_halo = false``, and no block outgrows a task.
    ``index`` is a dense 0-based position in the group.
    """
    forced = session.rows_per_chunk(df.sparkSession)
    if forced:
        block = min(block, forced)
    block = max(block, reach + 1)
    home = F.floor(F.col(index) / F.lit(block))
    offset = F.pmod(F.col(index), F.lit(block))
    seats = F.filter(
        F.array(
            F.struct(home.alias("_block"), F.lit(False).alias("_halo")),
            F.when(offset >= block - reach, F.struct((home + 1).alias("_block"), F.lit(True).alias("_halo"))),
            F.when((offset < reach) & (home > 0),
                   F.struct((home - 1).alias("_block"), F.lit(True).alias("_halo"))),
        ),
        lambda s: s.isNotNull())
    return df.select("*", F.inline(seats))


def block_window(keys: list[str], index: str):
    """The window that goes with :func:`with_halo`."""
    return Window.partitionBy(*keys, "_block").orderBy(index)


# ------------------------------------------------------------------------- quantiles
# Distinct values of one group that a task sorts without being cut into chunks.
BOUNDED_GROUP = 100_000


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per probability.

    Large inputs are counted per distinct value and the cumulative counts are searched
    for the two ranks around each quantile, so no group is ever held in one place.
    """
    if session.surely_small(df) and not keys:
        return df.agg(*[F.percentile(value, F.lit(p)).alias(name) for name, p in probs.items()])
    if session.surely_small(df):
        found = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("_sorted"))
        pos = {name: F.lit(p) * (F.size("_sorted") - 1) for name, p in probs.items()}
        return found.select(*keys, *[_between(
            F.get("_sorted", F.floor(at).cast("int")), F.get("_sorted", F.ceil(at).cast("int")), at - F.floor(at)).alias(name)
            for name, at in pos.items()])
    counts = session.durable(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    bounded = bool(keys) and session.rows_per_chunk(df.sparkSession) is None and (counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows")).first()[0] or 0) <= BOUNDED_GROUP
    if bounded:  # many groups, none of them large: a window a group, which keeps those without values
        group, n = Window.partitionBy(*keys), F.when(F.col(value).isNotNull(), F.col("_n")).otherwise(0)
        placed = counts.withColumns({"_cum": F.sum(n).over(group.orderBy(value)), "_total": F.sum(n).over(group)})
    else:
        ranked = cut(counts.filter(F.col(value).isNotNull()), keys, [value]).add(_cum=RunningSum(F.col("_n"))).rows()
        total = F.max("_cum").alias("_total")
        totals = ranked.groupBy(*keys).agg(total) if keys else ranked.agg(total)
        placed = join_same(ranked, totals, keys) if keys else _attach_row(ranked, totals)
    exprs = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_total") - 1)
        exprs.append(F.min(F.when(F.col("_cum") > F.floor(pos), F.col(value))).alias(f"_lo_{name}"))
        exprs.append(F.min(F.when(F.col("_cum") > F.ceil(pos), F.col(value))).alias(f"_hi_{name}"))
        exprs.append(F.max(pos - F.floor(pos)).alias(f"_w_{name}"))
    found = placed.groupBy(*keys).agg(*exprs) if keys else placed.agg(*exprs)
    picked = [_between(F.col(f"_lo_{n}").cast("double"), F.col(f"_hi_{n}").cast("double"), F.col(f"_w_{n}")).alias(n) for n in probs]
    result = found.select(*keys, *picked)
    if bounded or not keys:
        return result
    return join_same(counts.select(*keys).distinct(), result, keys, "left")


def _between(lo: Column, hi: Column, share: Column) -> Column:
    """The point ``share`` of the way from ``lo`` to ``hi``, NULL for NULLs.

    ``lo * (1 - share)`` is added unrounded, as DuckDB's ``quantile_cont`` does; a value that lies
    exactly on a border made of two quantiles is else on its other side.
    """
    known = [F.coalesce(c, F.lit(0.0)) for c in (lo, 1 - share, hi * share)]
    return F.when(lo.isNotNull(), F.reflect(F.lit("java.lang.Math"), F.lit("fma"), *known).cast("double"))


def _attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as literals."""
    row = one_row.first()
    return df.withColumns({
        name: F.lit(row[name]).cast(one_row.schema[name].dataType) for name in one_row.columns})


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Add the tie-averaged 1-based rank of ``value`` within each group."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = cut(counts, keys, [value]).add(_cum=RunningSum(F.col("_n"))).rows()
    ranks = ranked.select(
        *keys, value, (F.col("_cum") - (F.col("_n") - 1) / F.lit(2.0)).alias(name))
    return join_same(df.filter(F.col(value).isNotNull()), ranks, [*keys, value])


# --------------------------------------------------------------------------- islands

def runs(ordered: Ordered, flag: Column, index: str) -> DataFrame:
    """Maximal runs of consecutive rows where ``flag`` is true.

    One row per run: keys, ``lo``, ``hi`` (inclusive positions) and ``n``.
    """
    flagged = Ordered(ordered.df.withColumn("_flag", F.coalesce(flag, F.lit(False))),
                      ordered.keys, ordered.order, ordered.chunked)
    # Inside a run, position minus the count of flagged rows so far is constant.
    numbered = flagged.add(_seen=RunningSum(F.col("_flag").cast("long"))).rows()
    return (numbered.filter("_flag")
            .groupBy(*ordered.keys, (F.col(index) - F.col("_seen")).alias("_run"))
            .agg(F.min(index).alias("lo"), F.max(index).alias("hi"),
                 F.count(F.lit(1)).alias("n"))
            .drop("_run"))


# --------------------------------------------------------------------- interval join

def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], point: str,
                  lo: str, hi: str, how: str = "inner", width: int = 1024) -> DataFrame:
    """Join integer points to spans ``[lo, hi)`` within ``keys``.

    Spans are spread over fixed-width cells of the point axis, so the join is an
    equi-join on (keys, cell) and a long group is spread over many tasks.
    """
    cells = spans.filter(F.col(hi) > F.col(lo)).withColumn("_cell", F.explode(F.sequence(
        F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))
    seated = points.withColumn("_cell", F.floor(F.col(point) / width))
    p, s = seated.alias("p"), cells.alias("s")
    on = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in [*keys, "_cell"]]
    on += [F.col(f"p.{point}") >= F.col(f"s.{lo}"), F.col(f"p.{point}") < F.col(f"s.{hi}")]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    joined = p.join(s, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_cell")
    extra = [F.col(f"s.{c}") for c in spans.columns if c not in keys]
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *extra)
