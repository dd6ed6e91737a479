"""Where queries register themselves, beside the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, folder) -> DataFrame under its name."""

    def add(function: Callable) -> Callable:
        REGISTRY[function.__name__] = (function, sql)
        return function

    return add
