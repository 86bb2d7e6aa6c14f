"""Operators on series: every function takes DataFrames and returns a DataFrame."""
