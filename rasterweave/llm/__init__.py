"""Operators for text and training-data corpora. Nothing outside this package imports it."""
