"""Concord: record reconciliation and data-quality operators for Spark DataFrames."""
