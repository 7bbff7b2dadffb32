"""Writers of study outputs, all into the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograin.operators.ordered import Index, cut
from tempograin.session import scratch_path


def rewritten_parquet(df: DataFrame, stem: str) -> DataFrame:
    """Write the rows as parquet and return the table read back."""
    path = scratch_path(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def json_lines(df: DataFrame, stem: str) -> str:
    """Write every row as one JSON document per line; NULL fields are kept."""
    path = scratch_path(df.sparkSession, stem)
    df.write.option("ignoreNullFields", "false").json(path)
    return path


def markdown_row(columns: list[str]) -> Column:
    """A row as one line of a markdown table."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown_table(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Lines of a markdown table: header, rule, then the rows; ``line_no`` orders them."""
    head = ["| " + " | ".join(columns) + " |", "|" + "|".join(["---"] * len(columns)) + "|"]
    body = cut(df, [], order).add(_i=Index()).rows().select(
        (F.col("_i") + 2).alias("line_no"), markdown_row(columns).alias("line"))
    # The two heading lines ride on the first row only, so an empty table has none.
    heads = body.filter("line_no = 2").select(F.inline(F.array(*[
        F.struct(F.lit(i).cast("long").alias("line_no"), F.lit(h).alias("line")) for i, h in enumerate(head)])))
    return heads.unionByName(body)
