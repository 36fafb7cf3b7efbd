"""Operators of a training-data pipeline: near-duplicates, filters, mixing, tokens."""
