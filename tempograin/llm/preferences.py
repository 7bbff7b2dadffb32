"""Chat formatting of preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograin.llm.common import broadcast_if_small, query, stored

CHOSEN, REJECTED = 1, 2
TURNS_PER_CHUNK = 256


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), turn["role"], F.lit("\n"), turn["text"], F.lit("<|im_end|>\n"))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """``start-end`` spans, in characters, of what the assistant says, end mark included."""
    def step(state, turn):
        head = state["at"] + F.length(turn["role"]) + 13
        tail = head + F.length(turn["text"]) + 10
        span = F.concat(head.cast("string"), F.lit("-"), tail.cast("string"))
        return F.struct(
            (tail + 1).cast("long").alias("at"),
            F.when(turn["role"] == "assistant", F.concat(state["spans"], F.array(span)))
            .otherwise(state["spans"]).alias("spans"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, start, step, lambda s: s["spans"]), ",")


def format_preferences(chosen: DataFrame, rejected: DataFrame, chunk: int = TURNS_PER_CHUNK) -> DataFrame:
    """Prompt and two masked completions for each conversation id of either side.

    Both inputs have conv_id, turn, role and text. Turns are ordered by their number. The
    longest common prefix ends before the first turn at which the sides differ; it is
    rendered once, as ``prompt``. A mask lists the spans of its completion that count
    towards the loss.

    A row holds ``chunk`` turn numbers, so a conversation has one row up to that length and
    further rows beyond it, in the order of ``chunk``; joined, they are the whole.

    Exact repeats of a row count once. Rows that share a turn number are ordered by role
    and text and belong to the same turn. A null turn comes before all others (as -1), a
    null role or text is rendered as an empty one. A null conv_id is an id like any other.
    Equal sides give empty completions and a null ``first_difference``. A conversation of
    one side alone has an empty prompt. Other columns are ignored.
    """
    def side(df, mark):
        return df.select("conv_id", F.coalesce(F.col("turn"), F.lit(-1)).cast("long").alias("turn"),
                         F.coalesce(F.col("role"), F.lit("")).alias("role"),
                         F.coalesce(F.col("text"), F.lit("")).alias("text"), F.lit(mark).alias("side"))
    rows = side(chosen, CHOSEN).unionByName(side(rejected, REJECTED))
    # Sides are compared by digests, so the texts are moved once, when they are gathered.
    digest = F.unhex(F.sha1(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    first = stored(
        rows.groupBy("conv_id", "turn", digest.alias("_digest")).agg(F.bit_or("side").alias("sides"))
        .groupBy(F.col("conv_id").alias("_id")).agg(
            F.min(F.when(F.col("sides") != CHOSEN | REJECTED, F.col("turn"))).alias("first_difference")), "preference-first")
    common = F.col("first_difference").isNull() | (F.col("turn") < F.col("first_difference"))
    parted = (rows.join(broadcast_if_small(first), rows["conv_id"].eqNullSafe(first["_id"])).drop("_id")
              .filter((F.col("side") == CHOSEN) | ~common))
    turn = F.struct("turn", "role", "text")

    def turns(condition):
        return F.sort_array(F.collect_set(F.when(condition, turn)))
    gathered = parted.groupBy(
        "conv_id", F.floor(F.col("turn") / chunk).cast("int").alias("chunk"), "first_difference").agg(
        turns(common).alias("_prompt"),
        turns(~common & (F.col("side") == CHOSEN)).alias("_chosen"),
        turns(~common & (F.col("side") == REJECTED)).alias("_rejected"))
    return gathered.select(
        "conv_id", "chunk", "first_difference",
        *[F.size(f"_{p}").cast("long").alias(f"n_{p}_turns") for p in ("prompt", "chosen", "rejected")],
        *[_text(F.col(f"_{p}")).alias(p) for p in ("prompt", "chosen", "rejected")],
        *[_mask(F.col(f"_{p}")).alias(f"{p}_mask") for p in ("chosen", "rejected")])


def swapped_last_reply(conversations: DataFrame) -> DataFrame:
    """The conversations with their last assistant reply replaced by the one before it.

    Where there is no reply before it, the replacement is empty.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    said = rows.filter(F.col("role") == "assistant")
    places = said.select("conv_id", "turn").distinct()
    last = places.groupBy(F.col("conv_id").alias("_id")).agg(F.max("turn").alias("_last"))
    earlier = places.join(last, places["conv_id"].eqNullSafe(last["_id"])).groupBy("_id", "_last").agg(
        F.max(F.when(F.col("turn") < F.col("_last"), F.col("turn"))).alias("_before"))
    ends = stored(earlier, "preference-ends")  # turn numbers alone, one row a conversation
    marked = rows.join(broadcast_if_small(ends), rows["conv_id"].eqNullSafe(ends["_id"]), "left")
    is_last = F.coalesce((F.col("role") == "assistant") & (F.col("turn") == F.col("_last")), F.lit(False))
    other = (marked.filter((F.col("role") == "assistant") & (F.col("turn") == F.col("_before")))
             .groupBy(F.col("conv_id").alias("_from")).agg(F.max("text").alias("_text")))
    replaced = marked.filter(is_last).select("conv_id", "turn", "role")
    swapped = replaced.join(other, replaced["conv_id"].eqNullSafe(other["_from"]), "left")
    return marked.filter(~is_last).select(rows.columns).unionByName(
        swapped.select("conv_id", "turn", "role", F.coalesce("_text", F.lit("")).alias("text")))


_ORACLE = """
WITH base AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text, turn AS raw FROM conversations),
lasts AS (SELECT conv_id, max(raw) AS last FROM base WHERE role = 'assistant' GROUP BY conv_id),
swaps AS (
  SELECT l.conv_id, l.last, (SELECT b.text FROM base b WHERE b.conv_id = l.conv_id AND b.role = 'assistant' AND b.raw < l.last
                             ORDER BY b.raw DESC, b.text DESC LIMIT 1) AS other FROM lasts l),
sides AS (
  SELECT conv_id, turn, role, text, 1 AS side FROM base
  UNION ALL
  SELECT b.conv_id, b.turn, b.role,
         CASE WHEN b.role = 'assistant' AND b.raw = s.last THEN coalesce(s.other, '') ELSE b.text END, 2
  FROM base b LEFT JOIN swaps s ON s.conv_id = b.conv_id),
merged AS (SELECT conv_id, turn, role, text, bit_or(side) AS sides FROM sides GROUP BY ALL),
firsts AS (SELECT conv_id, min(turn) FILTER (WHERE sides <> 3) AS first_difference FROM merged GROUP BY conv_id),
parted AS (
  SELECT m.*, f.first_difference, (f.first_difference IS NULL OR m.turn < f.first_difference) AS common,
         CAST(floor(m.turn / 256.0) AS INTEGER) AS chunk,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown
  FROM merged m JOIN firsts f USING (conv_id)),
spans AS (
  SELECT *, coalesce(sum(CASE WHEN NOT common AND (sides & 1) > 0 THEN length(shown) END) OVER w, 0) AS at1,
            coalesce(sum(CASE WHEN NOT common AND (sides & 2) > 0 THEN length(shown) END) OVER w, 0) AS at2
  FROM parted
  WINDOW w AS (PARTITION BY conv_id, chunk ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
marks AS (
  SELECT *, CAST(at1 + length(role) + 13 AS VARCHAR) || '-' || CAST(at1 + length(role) + length(text) + 23 AS VARCHAR) AS s1,
            CAST(at2 + length(role) + 13 AS VARCHAR) || '-' || CAST(at2 + length(role) + length(text) + 23 AS VARCHAR) AS s2
  FROM spans)
SELECT conv_id, chunk, first_difference,
       count(*) FILTER (WHERE common) AS n_prompt_turns,
       count(*) FILTER (WHERE NOT common AND (sides & 1) > 0) AS n_chosen_turns,
       count(*) FILTER (WHERE NOT common AND (sides & 2) > 0) AS n_rejected_turns,
       coalesce(string_agg(shown, '' ORDER BY turn, role, text) FILTER (WHERE common), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY turn, role, text) FILTER (WHERE NOT common AND (sides & 1) > 0), '') AS chosen,
       coalesce(string_agg(shown, '' ORDER BY turn, role, text) FILTER (WHERE NOT common AND (sides & 2) > 0), '') AS rejected,
       coalesce(string_agg(s1, ',' ORDER BY turn, role, text) FILTER (WHERE NOT common AND (sides & 1) > 0 AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(s2, ',' ORDER BY turn, role, text) FILTER (WHERE NOT common AND (sides & 2) > 0 AND role = 'assistant'), '') AS rejected_mask
FROM marks GROUP BY conv_id, chunk, first_difference
"""


@query("op5_preferences", _ORACLE)
def op5(t):
    return format_preferences(t.conversations, swapped_last_reply(t.conversations))
