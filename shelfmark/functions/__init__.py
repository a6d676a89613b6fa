"""Scalar functions, each from Column to Column on built-in expressions."""
