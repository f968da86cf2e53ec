"""Operators on DataFrames: masking, integrity, discovery, metrics, subsets and comparisons."""
