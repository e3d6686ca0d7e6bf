"""Operators for building training data: deduplication, filters, mixing, sharding, formatting."""
