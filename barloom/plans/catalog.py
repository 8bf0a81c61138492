"""Registered queries and their oracle SQL, gathered from the topic modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.plans.oracle_types import typed

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (
    "windows", "features", "scans", "quality", "ingestion", "risk_plans", "labels", "joins", "trades",
    "analytics", "stateful", "lifecycle_log", "ranking", "learning", "scalars", "streams",
)


def _gather(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        try:
            module = importlib.import_module(f"barloom.plans.{name}")
        except ModuleNotFoundError as missing:
            if missing.name != f"barloom.plans.{name}":
                raise
            continue
        out.update(getattr(module, attribute))
    return out


def queries() -> dict[str, Query]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return {name: typed(name, text) for name, text in _gather("ORACLES").items()}
