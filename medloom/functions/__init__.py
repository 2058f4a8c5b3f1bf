"""Scalar and aggregate functions, and rules about names."""
