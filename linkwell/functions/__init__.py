"""Column expressions and scalar functions."""
