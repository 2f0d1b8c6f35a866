"""Clause bodies as DataFrames."""
