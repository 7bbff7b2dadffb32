"""A null subject is a subject like any other."""

import math

import pytest

from tempograin.operators import series
from tempograin.operators import evaluation as ev


@pytest.fixture(scope="module")
def both(spark):
    """The same swings under the name a and under null."""
    rows = [(k, i, 40 * math.sin(i / 5) if i % 17 else None) for k in ("a", None) for i in range(300)]
    return spark.createDataFrame(rows, "subject string, frame long, value double")


def alike(df, n=None):
    """What the two subjects get, which must be equal and not empty."""
    rows = [r.asDict() for r in df.collect()]
    a = sorted((tuple(v for k, v in r.items() if k != "subject") for r in rows if r["subject"] == "a"), key=str)
    none = sorted((tuple(v for k, v in r.items() if k != "subject") for r in rows if r["subject"] is None), key=str)
    assert a == none and a and len(rows) == 2 * len(a)
    return a


@pytest.mark.parametrize("rows", [None, 40])
def test_events_and_cycles(both, spark, chunked, rows):
    if rows:
        chunked(rows)
    keys = ["subject"]
    alike(series.swing(both, keys))
    events = series.hysteresis_events(both, keys)
    assert len(alike(events)) > 3
    alike(series.cycles(events, keys, 30.0))
    alike(series.cycle_summary(series.cycles(events, keys, 30.0), keys))


def test_scores(spark):
    rows = [(k, i % 2 if i % 5 else 1, (i * 37 % 100) / 100) for k in ("a", None) for i in range(60)]
    df = spark.createDataFrame(rows, "subject string, y int, p double")
    alike(ev.average_precision(df, ["subject"], "y", "p"))
    alike(ev.auc(df, ["subject"], "y", "p"))
