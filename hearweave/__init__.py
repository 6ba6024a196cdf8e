"""Transcript reconciliation and review jobs as Spark DataFrames."""
