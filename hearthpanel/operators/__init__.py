"""Operators: DataFrames and column names in, a DataFrame out."""
