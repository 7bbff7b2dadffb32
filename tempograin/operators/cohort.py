"""Cohort curation: labels, masks, profiles, demographics, funnels and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograin.functions import text as tx
from tempograin.functions.numeric import portable_hash, ratio
from tempograin.operators.ordered import quantiles


def prepare(sessions: DataFrame) -> DataFrame:
    """Typed, labelled, sentinel-masked sessions; missing flags come before the mask."""
    years = tx.to_number(F.col("years"))
    typed = sessions.select(
        "sub_id", "filename", "datestring", "injdefn", "injjoint", "specinjury",
        tx.mixed_timestamp(F.col("datestring")).alias("dated"),
        tx.injury_status(F.col("injdefn"), F.col("injjoint"), F.col("specinjury")).alias("status"),
        tx.merge_synonyms(F.col("specinjury")).alias("injury"),
        *[tx.in_range(tx.to_number(F.col(c)), b).alias(c) for c, b in tx.PLAUSIBLE.items()],
        (years.isNull() | ~years.between(*tx.PLAUSIBLE["years"])).cast("int").alias("years_missing"),
        tx.is_blank(F.col("level")).cast("int").alias("level_missing"),
        F.when(tx.is_blank(F.col("gender")), "missing").otherwise(tx.normalise(F.col("gender"))).alias("gender"),
        F.when(tx.is_blank(F.col("level")), "missing").otherwise(tx.normalise(F.col("level"))).alias("level"))
    return typed.withColumn("wave", F.year("dated")).withColumn(
        "label", F.when(F.col("status") == "injured", 1).when(F.col("status") == "uninjured", 0))


def mask_dead_columns(df: DataFrame, columns: list[str], bar: float = 0.20) -> DataFrame:
    """Zero becomes NULL in columns where more than ``bar`` of the rows are exactly zero."""
    rates = df.agg(*[F.avg((F.col(c) == 0).cast("double")).alias(c) for c in columns]).first()
    dead = [c for c in columns if rates[c] is not None and rates[c] > bar]
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in dead}) if dead else df


def unpivot(df: DataFrame, keys: list[str], columns: list[str], kind: str = "double") -> DataFrame:
    """Long form: one row per key and column."""
    return df.unpivot(keys, [F.col(c).cast(kind).alias(c) for c in columns], "column", "value")


def unusable_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column, how many rows hold no usable number."""
    long = unpivot(df, [], columns)
    return long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("value").isNull() | F.isnan("value")).alias("n_unusable"),
        F.avg((F.col("value").isNull() | F.isnan("value")).cast("double")).alias("rate"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column: blanks, distinct values and whether most values are numbers.

    Equal values are counted together before anything is gathered per column.
    """
    long = unpivot(df, [], columns, "string")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    blank = tx.is_blank(F.col("value"))
    number = tx.to_number(F.col("value")).isNotNull() & ~blank
    out = counts.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("n_null"),
        F.count("value").alias("n_distinct"),
        F.sum(F.when(number, F.col("n")).otherwise(0)).alias("_numeric"))
    kind = F.when(F.col("_numeric") > 0.5 * (F.col("n_rows") - F.col("n_null")), "numeric").otherwise("text")
    return out.select("column", kind.alias("kind"), "n_null", "n_distinct",
                      ratio(F.col("n_null"), F.col("n_rows")).alias("null_rate"))


def offenders(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside their column's plausible range, with how often each occurs."""
    numeric = df.select(*[tx.to_number(F.col(c)).alias(c) for c in ranges])
    long = unpivot(numeric, [], list(ranges))
    outside = None
    for c, (lo, hi) in ranges.items():
        test = (F.col("column") == c) & ~F.col("value").between(lo, hi)
        outside = test if outside is None else outside | test
    return long.filter(outside).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def first_known_per_group(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Per group and column, the first non-null value in ``order`` (nulls in order last).

    A minimum over (order, value) pairs: partial aggregates on every task, so one long
    group costs no more than many short ones.
    """
    place = []
    for c in order:
        place += [F.col(c).isNull().alias(f"{c}_last"), F.col(c).alias(c)]
    picks = [
        F.min(F.when(F.col(c).isNotNull(), F.struct(F.struct(*place).alias("at"), F.col(c).alias("v"))))["v"].alias(c)
        for c in columns]
    return df.groupBy(*keys).agg(*picks)


def demographics(df: DataFrame, group: str, means: list[str]) -> DataFrame:
    """Per group: counts by sex and means over each subject's first dated session."""
    firsts = first_known_per_group(df, [group, "sub_id"], ["dated", "filename"], ["gender", *means])
    per_group = firsts.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_subjects"),
        F.count_if(F.col("gender") == "male").alias("n_male"),
        F.count_if(F.col("gender") == "female").alias("n_female"),
        *[F.avg(c).alias(f"mean_{c}") for c in means])
    return per_group.join(df.groupBy(group).agg(F.count(F.lit(1)).alias("n_sessions")), group)


def compare_cells(observed: DataFrame, expected: DataFrame, keys: list[str], counts: list[str],
                  tolerance: float = 0.01) -> DataFrame:
    """Published against observed cells: counts must be equal, other cells within tolerance.

    Both sides are long with ``column`` and ``value``.
    """
    o, e = observed.withColumnRenamed("value", "observed"), expected.withColumnRenamed("value", "expected")
    gap = F.abs(F.col("observed") - F.col("expected"))
    match = F.when(F.col("column").isin(counts), gap == 0).otherwise(gap <= tolerance)
    return (e.join(o, [*keys, "column"], "left")
            .withColumn("matches", F.coalesce(match, F.lit(False))))


def wave_report(df: DataFrame) -> DataFrame:
    """Missing and label rates per collection wave, and how well a blank level predicts."""
    per_wave = df.groupBy("wave").agg(
        F.count(F.lit(1)).alias("n"), F.avg("label").alias("label_rate"),
        F.avg("years_missing").alias("years_missing_rate"), F.avg("level_missing").alias("level_missing_rate"),
        ratio(F.count_if((F.col("level_missing") == 1) & (F.col("label") == 0)),
              F.count_if(F.col("level_missing") == 1)).alias("blank_level_precision"))
    return per_wave


def repeats(df: DataFrame, subject: str = "sub_id") -> DataFrame:
    """How many subjects have each number of sessions."""
    per = df.groupBy(subject).agg(F.count(F.lit(1)).alias("sessions"))
    return per.groupBy("sessions").agg(F.count(F.lit(1)).alias("subjects"))


def repeats_summary(df: DataFrame, subject: str = "sub_id") -> DataFrame:
    """Minimum, median and maximum sessions per subject and how many repeat."""
    per = df.groupBy(subject).agg(F.count(F.lit(1)).alias("sessions"))
    middle = quantiles(per, [], "sessions", {"median": 0.5}).scalar()
    return per.agg(F.count(F.lit(1)).alias("n_subjects"), F.min("sessions").alias("fewest"),
                   F.max("sessions").alias("most"), F.count_if(F.col("sessions") > 1).alias("n_repeating"),
                   ).withColumn("median", middle)


def mixed_label_sessions(df: DataFrame) -> DataFrame:
    """Sessions of subjects whose label changes between sessions."""
    mixed = (df.groupBy("sub_id").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"))
             .filter("_lo <> _hi").select("sub_id"))
    return df.join(mixed, "sub_id", "left_semi")


def cross_tab(df: DataFrame, rows: str, columns: str, levels: list) -> DataFrame:
    """Counts by row and column level, and each as a share of its row."""
    counts = df.groupBy(rows).pivot(columns, levels).agg(F.count(F.lit(1))).na.fill(0)
    total = sum((F.col(f"`{v}`") for v in levels), F.lit(0))
    return counts.select(
        rows, *[F.col(f"`{v}`").cast("long").alias(f"n_{v}") for v in levels],
        *[ratio(F.col(f"`{v}`"), total).alias(f"share_{v}") for v in levels])


def funnel(df: DataFrame, subject: str, stages: list[tuple[str, Column]]) -> DataFrame:
    """Rows and distinct subjects left after each successive filter, in one pass.

    A row's depth is the number of stages it passes in a row; subjects are reduced to
    their deepest row first, so nothing counts distinct values per stage.
    """
    depth, passed = F.lit(0), F.lit(True)
    for _, condition in stages:
        passed = passed & F.coalesce(condition, F.lit(False))
        depth = depth + passed.cast("int")
    staged = df.select(subject, depth.alias("_depth"))
    per = staged.groupBy(subject).agg(
        F.max("_depth").alias("_deep"),
        *[F.count_if(F.col("_depth") >= i + 1).alias(f"_r{i}") for i in range(len(stages))])
    sums = per.agg(*[F.sum(f"_r{i}").alias(f"_r{i}") for i in range(len(stages))],
                   *[F.count_if(F.col("_deep") >= i + 1).alias(f"_s{i}") for i in range(len(stages))])
    rows = F.array(*[
        F.struct(F.lit(i + 1).cast("long").alias("step"), F.lit(name).alias("stage"),
                 F.coalesce(F.col(f"_r{i}"), F.lit(0)).alias("n_rows"), F.col(f"_s{i}").alias("n_subjects"))
        for i, (name, _) in enumerate(stages)])
    return sums.select(F.inline(rows))


def assignment_check(df: DataFrame, key: Column, label: Column, arms: int, bar: float = 0.06,
                     strict: bool = False) -> DataFrame:
    """Label rate in each arm of a random assignment against the overall rate."""
    assigned = df.select((portable_hash(key, F.lit("arm")) % arms).alias("arm"), label.cast("double").alias("_y"))
    per = assigned.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("_pos"))
    overall = per.agg(F.sum("_pos") / F.sum("n")).scalar()
    out = per.select(
        "arm", "n", (F.col("_pos") / F.col("n")).alias("rate"),
        F.abs(F.col("_pos") / F.col("n") - overall).alias("deviation"))
    ok = F.col("deviation") < bar
    if strict:
        ok = F.when(ok, True).otherwise(F.raise_error(F.lit("assignment is not independent of the label")))
    return out.withColumn("independent", ok)


def round_robin_sample(df: DataFrame, bucket: str, order: list[str], size: int) -> DataFrame:
    """The first ``size`` rows when buckets take turns, each in its own order.

    A bucket gives at most ``size`` rows, so the rank filter is pushed below the shuffle.
    """
    turn = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    return (df.withColumn("turn", turn).filter(F.col("turn") <= size)
            .orderBy("turn", bucket).limit(size).withColumn("turn", F.col("turn").cast("long")))
