"""Operators of the time-series engine: each takes and returns lazy DataFrames."""
