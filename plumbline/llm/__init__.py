"""Operators for corpora of texts; nothing outside this package imports it."""
