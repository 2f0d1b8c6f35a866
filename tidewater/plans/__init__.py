"""Checked programs, their evaluation, maintenance and storage."""
