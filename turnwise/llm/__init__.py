"""Operators for text corpora: rules, models, near-duplicates, packing, sharding, extraction."""
