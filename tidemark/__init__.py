"""Tidemark: industrial tag history on Spark DataFrames and Structured Streaming."""
