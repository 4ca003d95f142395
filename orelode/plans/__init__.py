"""Whole jobs put together from the operators; each only builds DataFrames."""
