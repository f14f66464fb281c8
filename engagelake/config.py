"""Paths and parameters, each with an environment override."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


def _env(name: str, default):
    return lambda: type(default)(os.environ.get(f"ENGAGELAKE_{name}", default))


@dataclass(frozen=True)
class LakeConfig:
    data_root: str = field(default_factory=_env("DATA_ROOT", "data"))
    raw_prefix: str = field(default_factory=_env("RAW_PREFIX", "raw"))
    bronze_prefix: str = field(default_factory=_env("BRONZE_PREFIX", "bronze"))
    silver_prefix: str = field(default_factory=_env("SILVER_PREFIX", "silver"))
    gold_prefix: str = field(default_factory=_env("GOLD_PREFIX", "gold"))
    table_format: str = field(default_factory=_env("FORMAT", "parquet"))
    seed: int = field(default_factory=_env("SEED", 42))
    results_limit: int = field(default_factory=_env("RESULTS_LIMIT", 30))
    default_clusters: int = field(default_factory=_env("CLUSTERS", 5))
    zone: str = field(default_factory=_env("ZONE", "America/Sao_Paulo"))
    link_column: str = field(default_factory=_env("LINK_COLUMN", "Link"))
    text_column: str = field(default_factory=_env("TEXT_COLUMN", "text"))

    def layer(self, name: str) -> str:
        prefix = {
            "raw": self.raw_prefix,
            "bronze": self.bronze_prefix,
            "silver": self.silver_prefix,
            "gold": self.gold_prefix,
        }[name]
        return f"{self.data_root.rstrip('/')}/{prefix.strip('/')}"
