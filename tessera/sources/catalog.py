"""A registry of named datasets: ``id[:subset][#n]`` to a DataFrame."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import sampling
from tessera.sources import readers


@dataclass
class Dataset:
    """How a dataset is read: a path (and format) or a function of the session and subset, then a preprocessing step."""

    name: str
    path: str | None = None
    format: str = "parquet"
    schema: str | None = None
    load: Callable[[SparkSession, str | None], DataFrame] | None = None
    preprocess: Callable[[DataFrame], DataFrame] | None = None
    subsets: dict[str, str] = field(default_factory=dict)
    columns: dict[str, str] = field(default_factory=dict)
    tags: tuple[str, ...] = ()


_REGISTRY: dict[str, Dataset] = {}


def register(dataset: Dataset, replace: bool = False) -> Dataset:
    if dataset.name in _REGISTRY and not replace:
        raise ValueError(f"dataset {dataset.name} is registered already")
    _REGISTRY[dataset.name] = dataset
    return dataset


def register_json(text: str, base: str = "") -> list[Dataset]:
    """Register a JSON list of datasets; relative paths are resolved against ``base``."""
    out = []
    for item in json.loads(text):
        path = item.get("path")
        if path and base and "://" not in path and not path.startswith("/"):
            item["path"] = f"{base.rstrip('/')}/{path}"
        out.append(register(Dataset(**item)))
    return out


def names(tag: str | None = None) -> list[str]:
    return sorted(n for n, d in _REGISTRY.items() if tag is None or tag in d.tags)


_SPEC = re.compile(r"^(?P<name>[^:#]+)(?::(?P<subset>[^#]+))?(?:#(?P<n>\d+))?$")


def load(spark: SparkSession, spec: str, id_column: str | None = None, seed: int = 0) -> DataFrame:
    """The dataset of a spec: all rows, of one subset, or (``#n``, needs an id column) exactly n rows, tiled if there are fewer."""
    parts = _SPEC.match(spec)
    if parts is None or parts["name"] not in _REGISTRY:
        raise KeyError(f"no dataset {spec}")
    d = _REGISTRY[parts["name"]]
    if d.load:
        df = d.load(spark, parts["subset"])
    else:
        path = d.subsets.get(parts["subset"], d.path) if parts["subset"] else d.path
        df = readers.jsonl(spark, path, d.schema or readers.CHAT_SCHEMA) if d.format == "jsonl" else spark.read.format(d.format).load(path)
    if d.columns:
        df = df.withColumnsRenamed(d.columns)
    if d.preprocess:
        df = d.preprocess(df)
    return df if parts["n"] is None else sampling.sample_exact(df, int(parts["n"]), id_column or df.columns[0], seed).drop("copy")
