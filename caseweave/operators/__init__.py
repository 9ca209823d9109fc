"""Operators: DataFrames in, DataFrames out. Plans say what is computed; Catalyst chooses how."""
