"""Structured Streaming in front of a database."""
