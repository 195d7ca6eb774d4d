"""Trace, code-graph, retrieval and experiment analytics on Spark DataFrames."""
