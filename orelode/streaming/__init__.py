"""Continuous forms of the feeds."""
