"""Annotation and retrieval analytics on Spark DataFrames."""
