"""Operators: DataFrames in, DataFrame out, nothing runs inside unless a model is fitted."""
