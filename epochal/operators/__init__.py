"""Operators: each takes DataFrames and returns a DataFrame, or a small fitted result."""
