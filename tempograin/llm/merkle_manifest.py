"""A Merkle manifest of a dataset by pivoting children into slots.

Rows are leaves, ordered within their language. Eight consecutive nodes are the children of
one parent: conditional aggregates spread them into eight slot columns, and hashing the
columns' concatenation gives the parent. Going down again, the slot columns to the left and
to the right of a node's own are its siblings, so a proof needs no join of nodes with nodes.
The roots of the languages are the leaves of one more tree, built alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograin.llm.common import lower_ascii, query, stored

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SLOTS = [f"s{i}" for i in range(FANOUT)]
PATH = "array<struct<l:string,r:string>>"


def encoded(value: Column) -> Column:
    """A value with its length in bytes in front, so that no two lists of values look alike; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts, concatenated, as lower-case hex."""
    return F.sha2(F.concat(*parts), 256)


def leaf(text: Column | None = None) -> Column:
    """A row's digest over its fields, with ``text`` in place of the field if given."""
    return digest(*[encoded(text if text is not None and c == "text" else F.col(c)) for c in FIELDS])


def lower_cased(text: Column) -> Column:
    """The tampering of the query: A-Z in lower case; null stays null."""
    return lower_ascii(text)


def every_third(doc_id: Column) -> Column:
    """Whether 3 divides the CRC-32 of the id's decimal form; a null id is left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def group_name(lang: Column) -> Column:
    """Languages as text that sorts null first and the others by their bytes."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def placed(rows: DataFrame, group: str, order: list[str], stem: str) -> DataFrame:
    """``rows`` with ``place``, from 0 without gaps within each group, and the group's size ``n``.

    Ranges of (group, order) are sorted and written once, each row with its place among all.
    What remains to be known is where a group starts in each range: one row per group and
    range, so that a group of any size is spread over as many tasks as it needs.
    """
    keys = [group, *order]
    written = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "_at", F.monotonically_increasing_id()), stem)
    part = F.shiftright("_at", 33).alias("_part")  # the number's upper bits tell the range
    parts = stored(written.groupBy(group, part).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")), f"{stem}-parts")
    each = Window.partitionBy(group)
    earlier = F.coalesce(F.sum("_rows").over(each.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(group, "_part", (earlier - F.col("_first")).alias("_shift"), F.sum("_rows").over(each).alias("n"))
    return written.withColumn("_part", part).join(starts, [group, "_part"]).withColumn(
        "place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def pivot(nodes: DataFrame, group: str, more: tuple[str, ...] = ()) -> DataFrame:
    """The parents of ``nodes`` (group, place, n, node): (group, place, n, node) with the children in slots.

    The columns ``more`` are spread into slots of their own, named after them.
    """
    spread = nodes.groupBy(group, F.floor(F.col("place") / FANOUT).alias("place")).agg(
        F.ceil(F.first("n") / FANOUT).alias("n"),
        *[F.expr(f"max(CASE WHEN place % {FANOUT} = {i} THEN {c} END) AS {name}{i}")
          for c, name in (("node", "s"), *zip(more, more)) for i in range(FANOUT)])
    return spread.withColumn("node", F.expr(f"sha2({_side(SLOTS)}, 256)"))


def _side(slots: list[str]) -> str:
    """The concatenated slot columns, absent ones being empty."""
    return "concat(" + ", ".join(f"coalesce({s}, '')" for s in slots) + ")"


def children(more: tuple[str, ...] = ()) -> Column:
    """The children of a parent with its ``path``, as structs of place, node, their own path (lowest level first) and ``more``.

    A child's siblings are the slots other than its own, on the left and on the right.
    """
    each = ", ".join(
        f"named_struct('place', place * {FANOUT} + {i}, 'node', {s}, 'path', concat(array(named_struct("
        f"'l', {_side(SLOTS[:i])}, 'r', {_side(SLOTS[i + 1:])})), path)" + "".join(f", '{c}', {c}{i}" for c in more) + ")"
        for i, s in enumerate(SLOTS))
    return F.expr(f"filter(array({each}), c -> c.node IS NOT NULL)")


def levels(nodes: DataFrame, group: str, stem: str) -> tuple[list[DataFrame], DataFrame]:
    """The stored pivots above ``nodes``, lowest first, and the top node of each group (group, node).

    Ends when every group has one node; a group of one node is its own top.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    built: list[DataFrame] = []
    tops = [nodes.filter("n = 1").select(group, "node")]
    while most > 1:
        nodes = stored(pivot(nodes.filter("n > 1"), group), f"{stem}-level")
        built.append(nodes)
        tops.append(nodes.filter("n = 1").select(group, "node"))
        most = -(-most // FANOUT)
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    return built, top


def down(built: list[DataFrame], tops: DataFrame, group: str) -> DataFrame:
    """(group, place, path) of the nodes below the lowest pivot of ``built``.

    ``tops`` (group, path) says how the path goes on above each group's top node. A group
    whose top is below a pivot is not in it, and waits at place 0.
    """
    reached = tops.select(group, F.lit(0).cast("long").alias("place"), "path")
    for parents in reversed(built):
        both = reached.join(parents.drop("node", "n"), [group, "place"], "left")
        here = F.array(F.struct("place", F.col("s0").alias("node"), "path"))
        reached = both.select(group, F.inline(F.when(F.col("s0").isNull(), here).otherwise(children()))).drop("node")
    return reached


def manifest(docs: DataFrame, tamper: Callable[[Column], Column] = lower_cased,
             tampered: Callable[[Column], Column] = every_third) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    ``docs`` has doc_id, source, lang, n_chars and text, any of which may be null; other
    columns are ignored, whatever their names. Null languages are a group of their own, the
    first. Within a group rows are ordered by doc_id (null first), rows that share it by their
    digest, so the result does not depend on how the table is dealt; repeated rows are leaves
    of their own. ``tampered`` (of doc_id) picks the rows whose text is changed by ``tamper``
    before the root is recomputed from their original siblings. An empty table has no rows.
    """
    change = tampered(F.col("doc_id"))
    leaves = stored(docs.select(*FIELDS).select(
        "doc_id", group_name(F.col("lang")).alias("_group"), leaf().alias("node"),
        F.when(change, leaf(tamper(F.col("text")))).alias("changed"), F.monotonically_increasing_id().alias("_row")), "manifest-leaves")
    ordered = placed(leaves, "_group", ["doc_id", "node", "_row"], "manifest-ordered")

    # The lowest pivot carries what a leaf's result needs. A group of one leaf has no level: the leaf stands for its parent.
    lone = (F.col("n") == 1) & F.col("s1").isNull()
    lowest = stored(pivot(ordered, "_group", ("doc_id", "changed")).withColumn("_lone", lone).withColumn(
        "node", F.when(F.col("_lone"), F.col("s0")).otherwise(F.col("node"))), "manifest-pivot")
    above, tops = levels(lowest.select("_group", "place", "n", "node"), "_group", "manifest")
    subroots = stored(tops.select(F.lit("").alias("_all"), "_group", "node"), "manifest-subroots")
    named = stored(placed(subroots, "_all", ["_group"], "manifest-tops"), "manifest-named")
    top_levels, root = levels(named.select("_all", "place", "n", "node"), "_all", "manifest-root")
    top_paths = down(top_levels, root.select("_all", F.array().cast(PATH).alias("path")), "_all")
    groups = stored(named.join(top_paths, ["_all", "place"]).join(root.select("_all", F.col("node").alias("root")), "_all").select(
        "_group", F.col("node").alias("subroot"), "root", "path"), "manifest-groups")
    paths = down(above, groups.select("_group", "path"), "_group")

    rows = lowest.drop("n", "node").join(paths, ["_group", "place"]).select(
        "_group", "_lone", F.col("path").alias("_up"), F.inline(children(("doc_id", "changed")))).withColumn(
        "path", F.when(F.col("_lone"), F.col("_up")).otherwise(F.col("path"))).join(groups.drop("path"), "_group")
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["l"], p["r"])), ""), 256)
    folded = F.aggregate("path", F.coalesce("changed", "node"), lambda h, p: F.sha2(F.concat(p["l"], h, p["r"]), 256))
    return rows.select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def _sql_levels(first: str, n: int, name: str) -> str:
    """CTEs of ``n`` levels above ``first`` (g, p, node, n), each with the siblings to the left and right."""
    parts = []
    for k in range(n):
        here = first if k == 0 else f"{name}{k}"
        parts.append(f"""{name}s{k} AS MATERIALIZED (SELECT a.g, a.p, any_value(a.n) AS n, coalesce(string_agg(b.node, '' ORDER BY b.p) FILTER (b.p < a.p), '') AS l,
  coalesce(string_agg(b.node, '' ORDER BY b.p) FILTER (b.p > a.p), '') AS r FROM {here} a LEFT JOIN {here} b ON a.g = b.g AND a.p // {FANOUT} = b.p // {FANOUT} AND a.p <> b.p GROUP BY a.g, a.p)""")
        parts.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT g, p // {FANOUT} AS p, CASE WHEN any_value(n) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY p)) END AS node,
  (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n FROM {here} GROUP BY g, p // {FANOUT})""")
    return ", ".join(parts)


def oracle(depth: int = 8, top_depth: int = 3) -> str:
    """The manifest in SQL, for groups of up to 8 ** ``depth`` rows and 8 ** ``top_depth`` groups."""
    def part(value: str) -> str:
        return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf_sql(text: str) -> str:
        return "sha256(" + " || ".join(part(text if c == "text" else c) for c in FIELDS) + ")"
    # CRC-32 bit by bit: each byte, then seven zeros, each followed by one shift.
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"
    joins = " ".join(f"JOIN ls{k} ON ls{k}.g = r.g AND ls{k}.p = r.p // {FANOUT ** k}" for k in range(depth))
    joins += " JOIN ts t ON t.lang = r.g JOIN t0 ON t0.p = t.p" + "".join(
        f" JOIN ts{k} ON ts{k}.p = t.p // {FANOUT ** k}" for k in range(top_depth))
    steps, folds = [f"ls{k}" for k in range(depth)] + [f"ts{k}" for k in range(top_depth)], []
    for i, s in enumerate(steps):
        folds.append(f"f{i + 1} AS (SELECT * EXCLUDE (h), CASE WHEN n{i} = 1 THEN h ELSE sha256(l{i} || h || r{i}) END AS h FROM f{i})")
    columns = ", ".join(f"{s}.n AS n{i}, {s}.l AS l{i}, {s}.r AS r{i}" for i, s in enumerate(steps))
    proof = " || ".join(f"l{i} || r{i}" for i in range(len(steps)))
    return f"""WITH leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf_sql('text')} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM leaves),
l0 AS (SELECT g, p, leaf AS node, n FROM r), {_sql_levels('l0', depth, 'l')},
ts AS MATERIALIZED (SELECT g AS lang, node, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM l{depth}),
t0 AS (SELECT 0 AS g, p, node, n FROM ts), {_sql_levels('t0', top_depth, 't')},
f0 AS (SELECT r.doc_id, r.leaf, t.node AS subroot, coalesce(r.changed, r.leaf) AS h, {columns} FROM r {joins}), {", ".join(folds)}
SELECT doc_id, leaf, subroot, (SELECT node FROM t{top_depth}) AS root, sha256({proof}) AS proof_sha256, h AS folded_root,
  h = (SELECT node FROM t{top_depth}) AS verified FROM f{len(steps)}"""


@query("op13_merkle_manifest", oracle())
def op13(t):
    return manifest(t.documents)
