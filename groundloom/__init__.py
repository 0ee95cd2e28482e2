"""Grounding analytics on Spark DataFrames."""
