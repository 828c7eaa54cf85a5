"""Scalar rules as Column expressions (no Python UDF)."""
