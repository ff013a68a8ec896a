"""Sparse linear algebra on Spark: vectors, matrices and partitions are DataFrames."""
