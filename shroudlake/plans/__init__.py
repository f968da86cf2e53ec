"""Policies, and their compilation to Column expressions."""
