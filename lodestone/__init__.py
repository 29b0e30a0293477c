"""Retrieval-memory engine on Spark DataFrames."""
