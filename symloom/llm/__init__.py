"""Operators for large training corpora: sharding, encoding, archives, deduplication, scoring, search and mixing."""
