"""Workflow facts on Spark: settings, products, files, task graphs, run history and reuse as DataFrames."""
