"""Queries on the shared tables, each beside the SQL it is compared with."""

from __future__ import annotations

import importlib

MODULES = ("health", "coverage", "keyed", "video", "web", "portfolio", "market", "media", "stream", "sources")


def load():
    from checks import registry

    for name in MODULES:
        importlib.import_module(f"checks.{name}")
    return registry.QUERIES, registry.SQL
