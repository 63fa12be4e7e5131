"""Tidemark: change-stream processing on Spark DataFrames."""
