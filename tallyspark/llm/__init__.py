"""Operators for large-scale training data: deduplication, filtering, extraction, encoding."""
