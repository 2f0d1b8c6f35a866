"""Incremental Datalog on Spark DataFrames."""
