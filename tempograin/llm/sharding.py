"""Sharding by balanced label propagation.

Documents with equal texts are linked. Linked documents start in a shard drawn from their
id and move, round by round, to the shard where most of their neighbours are, as far as
that shard's quota allows. A group larger than a quota is given as many home shards as it
needs. Unlinked documents then fill the shards up, so that row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograin.llm.common import query, stored

TEXT_KEY = ["_text", "text_crc32", "size"]
OVERHEAD_BYTES = 16


def shard_documents(docs: DataFrame, shards: int = 40, rounds: int = 4, block: int = 50_000) -> DataFrame:
    """Assign every row of ``docs`` (doc_id, text) to a shard and a slot in it.

    The law is ``rows``: shard sizes differ by one row at most, whatever the groups.
    ``block`` is the most rows that are numbered in one task.

    A null text has no bytes (size 16, CRC 0) and no neighbours. Empty texts are equal
    texts. Rows repeated with their id are separate rows, linked by their text. A null
    doc_id is an id like any other. An empty table gives an empty result. Other columns
    of ``docs`` are not read.
    """
    text = F.col("text")
    base = stored(docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("_text")), "shard-rows")
    n = base.count()
    quota = max(1, n // shards)
    groups = stored(base.filter(F.col("_text").isNotNull()).groupBy(*TEXT_KEY)
                    .agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "shard-groups")
    tagged = stored(base.join(groups, TEXT_KEY, "left").withColumn(
        "shard", F.when(F.col("copies").isNotNull(), _draw(shards, F.col("doc_id"), F.lit("start"))).cast("int")),
        "shard-tagged")
    linked = propagate(tagged.filter("copies is not null"), shards, quota, rounds)
    targets = [n // shards + (s < n % shards) for s in range(shards)]
    return _fill(linked, tagged.filter("copies is null"), targets, block)


def _draw(n: int, *parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(n))


def _unit(*parts: Column) -> Column:
    """A draw from [0, 1) that depends on ``parts`` alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def _is_large(quota: int) -> Column:
    return F.col("copies") * 8 > quota


def propagate(labels: DataFrame, shards: int, quota: int, rounds: int) -> DataFrame:
    """Move linked documents (text key, copies, shard) towards their neighbours' shards.

    Only the number of neighbours per (group, shard) is needed, which is at most
    ``shards`` rows a group; the pairs of a group are never formed. The first round is for
    the groups that are large against a quota, so that small ones do not stand in their way.
    """
    full: list[int] = []
    for step in range(rounds + 1):
        asks = F.lit(True) if step else _is_large(quota)
        cells = labels.groupBy(*TEXT_KEY, "copies", "shard").agg(F.count(F.lit(1)).alias("_here"))
        avoided = F.lit(False) if not full else F.col("shard").isin(full) & ~_is_large(quota)
        order = Window.partitionBy(*TEXT_KEY).orderBy(
            avoided, F.desc("_here"), F.xxhash64(*TEXT_KEY, "shard", F.lit(step)), "shard")
        homes = stored(
            cells.withColumn("_place", F.row_number().over(order))
            .filter(F.col("_place") <= F.ceil(F.col("copies") / F.lit(quota)))
            .groupBy(*TEXT_KEY).agg(F.sort_array(F.collect_list("shard")).alias("_homes")), "shard-homes")
        pick = F.pmod(F.xxhash64("doc_id", F.lit(step)), F.size("_homes")).cast("int")
        asked = stored(labels.join(homes, TEXT_KEY).withColumn(
            "_target", F.when(~asks | F.array_contains("_homes", F.col("shard")), F.col("shard"))
            .otherwise(F.get("_homes", pick))).withColumn(
            "_draw", F.when(F.size("_homes") == 1, _unit(*map(F.col, TEXT_KEY), F.lit(step)))
            .otherwise(_unit(F.col("doc_id"), F.lit(step)))).drop("_homes"), "shard-asked")
        # One row per shard comes to the driver.
        flows = {r["_target"]: r for r in asked.filter(asks).groupBy("_target").agg(
            F.count_if(F.col("shard") == F.col("_target")).alias("stay"),
            F.count_if(F.col("shard") != F.col("_target")).alias("ask")).collect()}
        allowed = [1.0] * shards
        for s, r in flows.items():
            if r["ask"]:
                allowed[s] = min(1.0, max(0, quota - r["stay"]) / r["ask"])
        full = [s for s, r in flows.items() if r["stay"] >= quota]
        share = F.get(F.array(*[F.lit(a) for a in allowed]), F.col("_target"))
        labels = asked.withColumn(
            "shard", F.when(F.col("_draw") < share, F.col("_target")).otherwise(F.col("shard"))
        ).drop("_target", "_draw")
        if step and not any(r["ask"] for r in flows.values()):
            break
    return labels


def _numbered(rows: DataFrame, keys: list[str], block: int, total: int) -> DataFrame:
    """Add ``_rank``: 0-based per ``keys``, in the order of ``_hash``, in blocks of bounded size."""
    blocks = max(1, -(-total // block))
    cell = [*keys, "_block", "_part"]
    placed = rows.withColumn(
        "_block", F.shiftright(F.shiftrightunsigned("_hash", 33) * F.lit(blocks), 31)).withColumn(
        "_part", F.when(F.col("copies") > block, F.pmod(
            F.xxhash64("doc_id"), F.ceil(F.col("copies") / F.lit(block)))).otherwise(F.lit(0)))
    over = Window.partitionBy(*keys).orderBy("_block", "_part")
    offsets = placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    inside = Window.partitionBy(*cell).orderBy("_hash", *TEXT_KEY, "doc_id")
    return (placed.withColumn("_row", F.row_number().over(inside)).join(offsets, cell)
            .withColumn("_rank", F.col("_row") - 1 + F.coalesce(F.col("_before"), F.lit(0)))
            .drop("_row", "_before", "_block", "_part"))


def _fill(linked: DataFrame, single: DataFrame, targets: list[int], block: int) -> DataFrame:
    """Keep linked rows up to each shard's target and deal the rest out by need."""
    shards = len(targets)
    size = F.get(F.array(*[F.lit(t) for t in targets]), F.col("shard"))
    per_shard = max(1, sum(targets) // shards)
    # Large groups come first, and so are not the ones that overflow.
    ahead = F.when(_is_large(per_shard), F.shiftrightunsigned(F.xxhash64(*TEXT_KEY), 8)).otherwise(F.xxhash64(*TEXT_KEY))
    ranked = stored(_numbered(linked.withColumn("_hash", ahead), ["shard"], block, per_shard), "shard-ranked")
    held = [0] * shards
    for r in ranked.groupBy("shard").count().collect():  # one row per shard
        held[r["shard"]] = min(r["count"], targets[r["shard"]])
    kept = ranked.filter(F.col("_rank") < size)
    spare = ranked.filter(F.col("_rank") >= size).drop("_rank").unionByName(
        single.withColumn("_hash", F.xxhash64("doc_id", *TEXT_KEY)))
    edges, at = [], 0
    for s in range(shards):
        edges.append(at)
        at += targets[s] - held[s]
    starts = F.array(*[F.lit(e) for e in edges])
    after = F.array(*[F.lit(e) for e in [*edges[1:], at]])
    dealt = _numbered(spare.withColumn("_all", F.lit(0)), ["_all"], block, at).withColumn(
        "shard", F.size(F.filter(after, lambda e: e <= F.col("_rank")))).withColumn(
        "_slot", F.get(F.array(*[F.lit(h) for h in held]), F.col("shard"))
        + F.col("_rank") - F.get(starts, F.col("shard")))
    rows = kept.withColumn("_slot", F.col("_rank")).unionByName(dealt.drop("_all"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("_slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query("op1_balanced_shards")
def op1(t):
    return shard_documents(t.documents)
