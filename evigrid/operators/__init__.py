"""Operators: every function takes and returns DataFrames keyed by document or job."""
