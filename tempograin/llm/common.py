"""Registry and helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograin import session
from tempograin.sources.tables import Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

# The letters that are lower-cased, and the six ASCII white-space characters.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SPACES = " \t\n\x0b\f\r"


def query(name: str, oracle: str | None = None):
    """Register a function from :class:`Tables` to a DataFrame under ``name``."""
    def register(build: Callable[[Tables], DataFrame]):
        _QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if oracle is not None:
            _ORACLES[name] = oracle
        return build
    return register


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)


def stored(df: DataFrame, stem: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and continue from that copy.

    Lineage ends here, so a lost executor costs a re-read, not a recomputation.
    """
    path = session.scratch_path(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def same(left: Column, right: Column) -> Column:
    """Equality in which two nulls are equal."""
    return left.eqNullSafe(right)


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Mark a stored table for broadcasting if it has at most ``rows`` rows; count it first."""
    return F.broadcast(df) if df.count() <= rows else df
