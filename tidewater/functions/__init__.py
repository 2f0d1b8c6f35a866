"""Functors by name, as column expressions."""
