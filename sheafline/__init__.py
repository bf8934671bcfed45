"""Corpus bundling and usage analytics as Spark DataFrames."""
