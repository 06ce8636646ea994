"""Queries: importing a module registers its queries."""

from __future__ import annotations

import importlib

MODULES = ("behaviour", "reports", "poses", "ranking", "dense", "statistics", "labels", "models", "summaries")


def load() -> None:
    """Register the queries of all modules."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
