"""Operators on DataFrames: checks, keys, splits, blending, metrics, features, search."""
