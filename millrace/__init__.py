"""Curating, scoring and evaluating training data with Spark DataFrames."""
