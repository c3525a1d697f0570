"""All registered queries and their SQL equivalents."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "readings_queries",
    "rollup_queries",
    "official_queries",
    "title_queries",
    "scalar_queries",
    "markup_queries",
    "stream_queries",
    "composite_queries",
    "maintenance_queries",
    "store_queries",
)


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        entries = getattr(import_module(f"gatecount.plans.{name}"), attribute)
        clash = found.keys() & entries.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        found.update(entries)
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict:
    return _collect("ORACLES")
