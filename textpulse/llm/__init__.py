"""Operators for preparing training data: filters, duplicates, sharding, token files."""
