"""Operators of a training-data pipeline; nothing else in the package imports this subpackage."""

from __future__ import annotations

from importlib import import_module

from engagelake.llm.common import ORACLES, QUERIES

MODULES = ["warc", "minhash", "suffixes", "embeddings", "packing", "sharding", "language", "fingerprints", "mixing", "tokens",
           "pii", "fim", "merkle"]


def load() -> None:
    for module in MODULES:
        import_module(f"engagelake.llm.{module}")


__all__ = ["ORACLES", "QUERIES", "load"]
