"""Operators of a training-data pipeline over whole corpora, one module each, and their queries."""
