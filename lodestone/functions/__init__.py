"""Scalar functions: literal parsing in Python, everything per row as Column expressions."""
