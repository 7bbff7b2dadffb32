"""Column expressions: plain functions from Column to Column."""
