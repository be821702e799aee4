"""Tensor analytics on Spark DataFrames."""
