"""Audit, scoring and telemetry operators for labelled extraction data, on Spark DataFrames."""
