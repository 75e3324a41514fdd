"""Operators: DataFrames and a profile in, DataFrame out."""
