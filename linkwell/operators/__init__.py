"""Operators: lazy DataFrames in and out."""
