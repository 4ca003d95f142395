"""Readers for the job inputs and writers for the job outputs."""
