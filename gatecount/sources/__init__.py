"""Stored payloads in, tables out. Fetching is not part of the engine."""
