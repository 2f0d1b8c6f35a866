"""Operators for large training-corpus pipelines, each on Spark DataFrames."""
