"""The queries over the engine's own operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tessera.queries.registry import REGISTRY

for _area in ("corpus", "conversations", "tokens", "evaluation", "selection", "reports", "sources", "relational", "streams"):
    import_module(f"tessera.queries.{_area}")


def flagship(spark: SparkSession, root: str) -> DataFrame:
    return REGISTRY["full_clean_pipeline"][0](spark, root)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: function for name, (function, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
