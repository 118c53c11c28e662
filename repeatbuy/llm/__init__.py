"""Operators for large text corpora: search, filtering, deduplication, mixing, encoding."""
