"""Sparse count matrices and their axes as Spark tables."""
