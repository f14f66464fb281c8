"""Registered queries over the driver tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from engagelake.catalog.registry import ORACLES, QUERIES

MODULES = ["cleaning", "storage", "engagement", "tables", "statistics", "text", "models", "streams"]


def load() -> None:
    for module in MODULES:
        import_module(f"engagelake.catalog.{module}")


__all__ = ["ORACLES", "QUERIES", "load"]
