"""Attestra: incremental evidence views, candidate admission and evaluation on Spark DataFrames."""
