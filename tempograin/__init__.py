"""Cohort and time-series measurement on Spark DataFrames."""
