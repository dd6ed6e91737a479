"""The queries of this subpackage and, where SQL can state them, the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("canonical", "language", "leakage", "mixing", "packing", "pairs", "spans", "terms")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for name in _MODULES:
        module = import_module(f"tessera.llm.{name}")
        found |= {key: value for key, value in vars(module).items() if key[:1] == "p" and key[1:2].isdigit() and callable(value)}
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in _MODULES:
        found |= getattr(import_module(f"tessera.llm.{name}"), "SQL", {})
    return found
