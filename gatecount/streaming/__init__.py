"""Structured Streaming forms of the reading operators."""
