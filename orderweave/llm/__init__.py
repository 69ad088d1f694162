"""Operators for preparing training data: filtering, deduplication, search, mixing, encoding."""
