"""Registered queries, by family, each beside the SQL it is checked against."""

from tempograin.plans import (  # noqa: F401
    audit, cohort, curves, errors, evaluation, geometry, models, series, sources)
from tempograin.plans.registry import all_oracles, all_queries

__all__ = ["all_queries", "all_oracles"]
