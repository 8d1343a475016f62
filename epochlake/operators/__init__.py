"""Operators on DataFrames, by group."""
