"""Operators for building training corpora: encoding, scoring, filtering, deduplication, archives and sharding."""
