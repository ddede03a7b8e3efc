"""Operators for large-scale text pipelines. Nothing outside this package imports it."""
