"""Operators for large training-data pipelines: each is a function from DataFrame to DataFrame."""
