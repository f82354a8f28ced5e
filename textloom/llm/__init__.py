"""Operators for preparing training data: deduplication, sharding, tokens, search, packing and filters."""
