"""Column expressions and plain formatting functions."""
