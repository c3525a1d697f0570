"""Operators of a training-data pipeline: filtering, deduplication, tokens, packing, search, sharding."""
