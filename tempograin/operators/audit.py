"""Audit of inputs and reported numbers: checks, gates, budgets, provenance, vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograin import session
from tempograin.functions.numeric import correlation, ratio
from tempograin.operators.ordered import Ordered, join_same

# Bars of the input checks.
FPS = (50.0, 25.0)
SHORT_SIDE = (480, 360)
SECONDS = (8.0, 3.0)
MISS_SHARE = 0.20
VIEW = (0.60, 0.49)
MIN_TRAVEL = 0.01
ORDERED_ROWS = 2_000_000  # a larger group's mean is not added up in order, which is one task's work
# Words a report may not use.
BANNED = {
    "risk": r"\brisks?\b",
    "predict": r"\bpredict\w*\b",
    "injury": r"\binjur\w*\b",
    "diagnosis": r"\bdiagnos\w*\b",
    "abnormal": r"\babnormal\w*\b",
    "asymmetry index": r"asymmetry[\s\-]+index",
    "normal range": r"normal[\s\-]+ranges?\b",
}


# ------------------------------------------------------------------------ input checks

def _check(name: str, refuse: Column, warn: Column, value: Column, message: Column, bars: tuple) -> Column:
    status = F.when(F.coalesce(refuse, F.lit(False)), "refuse").when(F.coalesce(warn, F.lit(False)), "warn").otherwise("pass")
    return F.struct(F.lit(name).alias("name"), status.alias("status"), value.cast("double").alias("value"),
                    F.concat(F.lit(f"{name} "), message, F.lit(f" (warn below {bars[0]}, refuse below {bars[1]})")).alias("message"))


def input_checks() -> Column:
    """Five checks of a clip row as an array of (name, status, value, message).

    Reads fps, width, height, n_frames, n_detected, n_crowded and view_ratio.
    """
    fps, short = F.col("fps"), F.least("width", "height")
    known = fps.isNotNull() & (fps > 0)
    secs = F.when(known, F.col("n_frames") / fps).otherwise(0.0)
    miss = F.when(F.col("n_frames") > 0, 1.0 - F.col("n_detected") / F.col("n_frames"))
    view = F.col("view_ratio")

    def shown(c: Column, places: int = 1) -> Column:
        return F.coalesce(F.round(c, places).cast("string"), F.lit("unknown"))
    return F.array(
        _check("fps", ~known | (fps < FPS[1]), fps < FPS[0], F.when(known, fps), shown(fps), FPS),
        _check("resolution", short < SHORT_SIDE[1], short < SHORT_SIDE[0], short, short.cast("string"), SHORT_SIDE),
        _check("length", secs < SECONDS[1], secs < SECONDS[0], secs, shown(secs), SECONDS),
        _check("person", miss.isNull() | (F.col("n_crowded") > 0) | (miss > MISS_SHARE), miss > 0, miss,
               shown(miss, 3), (0.0, MISS_SHARE)),
        _check("viewpoint", view < VIEW[1], view.isNull() | (view < VIEW[0]), view, shown(view, 3), VIEW))


def worst_status(checks: Column) -> Column:
    """refuse beats warn beats pass."""
    rank = F.array_max(F.transform(checks, lambda c: F.when(c["status"] == "refuse", 2).when(c["status"] == "warn", 1).otherwise(0)))
    return F.when(rank == 2, "refuse").when(rank == 1, "warn").otherwise("pass")


def named_failures(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold; an undefined rule does not fail."""
    return F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, ok in rules.items()]))


def _run_in_order(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Adds ``_run``, the running sum of ``value`` by ``order``, and the row's number ``_at``; NULL in groups above ORDERED_ROWS."""
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def run(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"_run": F.sum(value).over(own), "_at": F.count(F.lit(1)).over(own)})
    if session.surely_small(df):
        return run(df)
    large = session.durable(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > ORDERED_ROWS).drop("_n"))
    if large.isEmpty():
        return run(df)
    rest = join_same(df, large, keys, "left_semi").withColumns({"_run": F.lit(None).cast("double"), "_at": F.lit(None).cast("long")})
    return run(join_same(df, large, keys, "left_anti")).unionByName(rest)


def contract_flags(df: DataFrame, keys: list[str], x: str, y: str, conf: str, target: float,
                   size: tuple[str, str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Flags of a prepared array per clip: finite, range, confidence, all-zero frames.

    With ``size``, the columns of a clip's image width and height, the array is in the image-size
    form: x goes to 1, y to height / width, both with 0.001 to spare, and a missing size is a flag.

    The last digit of a mean of doubles, on which its rounding and the bar may hang, depends on the order
    in which they are added. With ``order`` that is the order of the frames, however they are partitioned.
    """
    mean = F.avg(conf)
    if order:
        df = _run_in_order(df, keys, conf, order)
        mean = F.coalesce(F.max_by("_run", "_at") / F.count(conf), mean)
    bad = F.count_if(F.col(x).isNull() | F.col(y).isNull() | F.col(conf).isNull())
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"), bad.alias("_bad"),
        F.max(F.greatest(F.abs(F.col(x)), F.abs(F.col(y)))).alias("_max"), F.min(conf).alias("conf_min"),
        F.max(conf).alias("conf_max"), mean.alias("conf_mean"),
        F.count_if(F.abs(F.col(x)) + F.abs(F.col(y)) == 0).alias("_zero"),
        F.max(F.abs(F.col(x))).alias("_x"), F.max(F.abs(F.col(y))).alias("_y"),
        *[F.max(c).alias(n) for c, n in zip(size or (), ("_width", "_height"))])
    bounds = {"range exceeds 1": F.col("_max") <= 1.0 + 1e-6}
    if size:
        aspect = ratio(F.col("_height"), F.col("_width"))
        bounds = {"no resolution": aspect.isNotNull(), "x outside the image": aspect.isNull() | (F.col("_x") <= 1.0 + 1e-3),
                  "y outside the image": F.col("_y") <= aspect + 1e-3}
    rules = {"non-finite values": F.col("_bad") == 0, **bounds,
             "confidence outside [0, 1]": (F.col("conf_min") >= 0) & (F.col("conf_max") <= 1),
             "confidence mean off target": F.abs(F.col("conf_mean") - target) <= 0.05, "all-zero frames": F.col("_zero") == 0}
    return stats.withColumn("flags", named_failures(rules)).drop("_bad", "_max", "_zero", "_x", "_y", "_width", "_height")


def plausibility(df: DataFrame, keys: list[str], bands: dict[str, tuple[float, float]], left: str, right: str,
                 score: str, min_score: float) -> DataFrame:
    """Warnings per clip: values off their band, sides moving together, low scores."""
    parts = [F.avg((~F.col(c).between(lo, hi)).cast("double")).alias(f"_o_{c}") for c, (lo, hi) in bands.items()]
    stats = df.groupBy(*keys).agg(*parts, correlation(F.col(left), F.col(right)).alias("r"), F.avg(score).alias("mean_score"))
    rules = {f"{c} outside its band": F.col(f"_o_{c}") <= 0.05 for c in bands}
    rules["sides move together"] = F.col("r") <= 0.5
    rules["low score"] = F.col("mean_score") >= min_score
    return stats.withColumn("warnings", named_failures(rules)).drop(*[f"_o_{c}" for c in bands])


def reconcile_side(declared: Column, dx: Column) -> dict[str, Column]:
    """Declared side against the one travel suggests: the declared side always wins."""
    text = F.lower(F.trim(declared))
    near = F.when(text.isin("l", "left"), "l").when(text.isin("r", "right"), "r")
    suggested = F.when(F.abs(dx) >= MIN_TRAVEL, F.when(dx > 0, "r").otherwise("l"))
    warning = (F.when(near.isNull(), "invalid side").when(suggested.isNull(), "no suggestion")
               .when(suggested != near, "disagreement").otherwise(""))
    return {"near": near, "suggested": suggested, "warning": warning}


# ------------------------------------------------------------------- tolerance and match

def within_tolerance(a: Column, b: Column, rtol: float = 1e-4, atol: float = 1e-6) -> Column:
    """NULL equals NULL; otherwise |a-b| <= atol + rtol*|b|."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= atol + rtol * F.abs(b))


def tolerance_regression(expected: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """Per column of two long tables: rows compared, equal, missing, and dead-but-revived.

    A column that is zero everywhere in the expected table is dead and is not compared.
    """
    e, g = expected.withColumnRenamed("value", "_e"), got.withColumnRenamed("value", "_g")
    both = e.withColumn("_he", F.lit(1)).join(g.withColumn("_hg", F.lit(1)), [*keys, "column"], "full")
    matched = F.col("_he").isNotNull() & F.col("_hg").isNotNull()
    ok = within_tolerance(F.col("_g"), F.col("_e"))
    out = both.groupBy("column").agg(
        F.count_if(matched).alias("n_compared"), F.count_if(matched & ok).alias("n_equal"), F.count_if(~matched).alias("n_unmatched"),
        F.max(F.coalesce(F.abs("_e"), F.lit(0.0))).alias("_me"), F.max(F.coalesce(F.abs("_g"), F.lit(0.0))).alias("_mg"))
    live = F.col("_me") > 0
    return out.select("column", "n_compared", "n_equal", "n_unmatched", live.alias("live"), ((~live) & (F.col("_mg") > 0)).alias("revived"),
                      F.when(live, (F.col("n_equal") == F.col("n_compared")) & (F.col("n_unmatched") == 0)).alias("passed"))


def best_label(rows: DataFrame, session: str, label: str, reference: str, got: str) -> DataFrame:
    """Candidate label that reproduces most live reference values, first on ties.

    Resolved only when every live value agrees and there is at least one.
    """
    live = F.coalesce(F.col(reference) != 0, F.lit(False))
    agree = live & within_tolerance(F.col(got), F.col(reference))
    per = rows.groupBy(session, label).agg(F.count_if(live).alias("n_live"), F.count_if(agree).alias("n_agree"))
    best = F.min(F.struct((-F.col("n_agree")).alias("a"), F.col(label).alias("l"), F.col("n_live").alias("n")))
    return per.groupBy(session).agg(best.alias("_b")).select(
        session, F.col("_b")["l"].alias("label_used"), F.col("_b")["n"].alias("n_live"), (-F.col("_b")["a"]).alias("n_agree"),
        ((-F.col("_b")["a"] == F.col("_b")["n"]) & (F.col("_b")["n"] > 0)).alias("resolved"))


def identify_axis(curves: DataFrame, keys: list[str], plane: str, curve: str, target: str, bar: float = 0.9) -> DataFrame:
    """Plane whose curve maximum or minimum follows the target best, if clearly enough."""
    rows = curves.select(*keys, plane, F.inline(F.array(
        F.struct(F.lit("max").alias("extremum"), F.array_max(curve).cast("double").alias("_x"), F.col(target).alias("_y")),
        F.struct(F.lit("min").alias("extremum"), F.array_min(curve).cast("double").alias("_x"), F.col(target).alias("_y")))))
    r = rows.groupBy(*keys, plane, "extremum").agg(correlation(F.col("_x"), F.col("_y")).alias("r"))
    best = F.max(F.when(F.col("r").isNotNull(), F.struct(F.round(F.abs("r"), 9).alias("a"), (-F.col(plane)).alias("p"), F.col("extremum").alias("e"), F.col("r").alias("r"))))
    out = r.groupBy(*keys).agg(best.alias("_b")) if keys else r.agg(best.alias("_b"))
    return out.select(*keys, (-F.col("_b")["p"]).alias("plane"), F.col("_b")["e"].alias("extremum"), F.col("_b")["r"].alias("r"),
                      (F.col("_b")["a"] >= bar).alias("identified"))


# ---------------------------------------------------------------------------- the budget

def resolve_paths(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """Look up (file, path) pairs; a missing one stays, marked missing."""
    out = wanted.join(results.select("file", "path", "value"), ["file", "path"], "left")
    return out.withColumn("missing", F.col("value").isNull())


def budget_cells(results: DataFrame, rows: dict[str, str], quantities: list[str], limbs: list[str], files: DataFrame) -> DataFrame:
    """One cell per file, budget row, quantity and limb, with the path its value came from.

    ``rows`` maps a row name to its path template.
    """
    entries = [(r, t.format(q=q, limb=limb), q, limb) for r, t in rows.items() for q in quantities for limb in limbs]
    template = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(p).alias("path"), F.lit(q).alias("quantity"), F.lit(limb).alias("limb"))
                         for r, p, q, limb in entries])
    wanted = files.select("file", F.inline(template))
    return resolve_paths(results, wanted)


def quote(cells: DataFrame, declared: DataFrame, rate: float = 30.0, slack: float = 0.5) -> DataFrame:
    """The row-B figure for each leg: near column for the declared side, far for the other.

    The clip's frame rate adds notes and never changes the number.
    """
    sides = declared.withColumn("side", F.explode(F.array(F.lit("l"), F.lit("r")))).withColumn(
        "limb", F.when(F.col("side") == F.col("near_side"), "near").otherwise("far"))
    b = cells.filter("row = 'B'").select("file", "quantity", "limb", "value")
    joined = sides.join(b, ["file", "limb"])
    notes = F.array_compact(F.array(
        F.when(F.col("value").isNull(), "no cell"),
        F.when(F.col("value").isNotNull() & (F.col("fps") > rate + slack), "faster than measured"),
        F.when(F.col("value").isNotNull() & (F.col("fps") < rate - slack), "slower than measured")))
    return joined.withColumn("text", F.coalesce(F.format_number("value", 2), F.lit("UNMEASURED"))).withColumn("notes", notes)


def unsupported_numbers(shown: DataFrame, cells: DataFrame, slack: float = 0.005) -> DataFrame:
    """Numbers that are no cited cell, and whether they look like a row B moved by a row C.

    The sums are a fixed small set per document and are matched by rounded value.
    """
    cited = cells.filter("row = 'B' and value is not null").select("file", F.col("value").alias("shown")).distinct()
    loose = shown.join(cited, ["file", "shown"], "left_anti")
    b = cells.filter("row = 'B' and value is not null").select("file", F.col("value").alias("_b"))
    c = cells.filter(f"row = 'C' and abs(value) > {slack}").select("file", F.col("value").alias("_p"))
    steps = F.array(*[F.lit(k) for k in (1.0, -1.0, 0.5, -0.5, 0.1, -0.1)])
    sums = b.join(c, "file").select("file", F.explode(F.transform(steps, lambda k: F.col("_b") + k * F.col("_p"))).alias("_sum"))
    near = sums.withColumn("_cell", F.explode(F.array(*[F.floor(F.col("_sum") / (2 * slack)) + d for d in (-1, 0, 1)])))
    keyed = loose.withColumn("_cell", F.floor(F.col("shown") / (2 * slack)))
    hits = (keyed.join(near, ["file", "_cell"]).filter(F.round(F.abs(F.col("shown") - F.col("_sum")), 9) <= slack)
            .select("file", "shown").distinct().withColumn("combination", F.lit(True)))
    return loose.join(hits, ["file", "shown"], "left").withColumn("combination", F.coalesce("combination", F.lit(False)))


# ------------------------------------------------------------------------------ the words

def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line of the whole text, numbered from 1."""
    return df.select(key, F.posexplode(F.split(text, "\r\n|\n|\r")).alias("_i", "line")).select(
        key, (F.col("_i") + 1).alias("line_no"), "line")


def banned_terms(text_lines: DataFrame, key: str, terms: dict[str, str], pragma: str | None) -> DataFrame:
    """Banned terms by line, case-insensitive; a pragma with a reason exempts its line."""
    hit = F.filter(F.array(*[F.when(F.col("line").rlike(f"(?i){p}"), F.lit(t)) for t, p in terms.items()]), lambda t: t.isNotNull())
    open_lines = text_lines.filter(~F.col("line").rlike(rf"#\s*{pragma}:\s*\S")) if pragma else text_lines
    return open_lines.select(key, "line_no", F.explode(hit).alias("term"))


def pragma_problems(text_lines: DataFrame, key: str, terms: dict[str, str], pragma: str) -> DataFrame:
    """Pragmas without a reason, or on a line that needs none."""
    marked = text_lines.filter(F.col("line").rlike(rf"#\s*{pragma}"))
    reason = F.trim(F.regexp_extract("line", rf"#\s*{pragma}:?(.*)$", 1))
    before = F.regexp_extract("line", rf"^(.*?)#\s*{pragma}", 1)
    needed = F.lit(False)
    for p in terms.values():
        needed = needed | before.rlike(f"(?i){p}")
    problem = F.when(reason == "", "no reason").when(~needed, "not needed")
    return marked.select(key, "line_no", problem.alias("problem")).filter(F.col("problem").isNotNull())


def sparkline(ordered: Ordered, keys: list[str], value: str, width: int = 100) -> DataFrame:
    """At most ``width`` evenly picked values of each series as one glyph each.

    The pick is a filter on the dense position, so only the picked values are collected.
    """
    rows = ordered.df
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    w = F.least(F.lit(width), F.col("_n"))
    picks = F.transform(F.sequence(F.lit(0), w - 1), lambda j: F.floor(j * (F.col("_n") - 1) / F.greatest(w - 1, F.lit(1)) + 1e-9).cast("long"))
    wanted = sizes.select(*keys, F.explode(picks).alias("frame"))
    chosen = rows.join(wanted, [*keys, "frame"])
    span = chosen.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"),
                                     F.sort_array(F.collect_list(F.struct("frame", F.col(value).alias("v")))).alias("_p"))
    scale = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    # The glyphs, lowest first.
    glyphs = F.array(*[F.lit(g) for g in "_.-~=*#@"])
    text = F.array_join(F.transform("_p", lambda p: F.get(glyphs, F.coalesce(F.rint((p["v"] - F.col("_lo")) / scale * 7.0), F.lit(0.0)).cast("int"))), "")
    return span.select(*keys, F.when(F.size("_p") < 2, "(no signal)").otherwise(text).alias("spark"))
