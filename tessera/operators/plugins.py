"""Registries of preprocessors, samplers and multi-turn schedulers; functions from DataFrame to DataFrame."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators import messages as M
from tessera.runtime import staged

PREPROCESSORS: dict[str, Callable[[DataFrame], DataFrame]] = {}
SAMPLERS: dict[str, Callable[..., DataFrame]] = {}
SCHEDULERS: dict[str, type] = {}


def _adder(registry: dict) -> Callable:
    def named(name: str):
        def add(x):
            if name in registry:
                raise ValueError(f"{name} is registered already")
            registry[name] = x
            return x

        return add

    return named


preprocessor, sampler, scheduler = _adder(PREPROCESSORS), _adder(SAMPLERS), _adder(SCHEDULERS)


def load_plugins(*modules: str) -> None:
    """Import modules that register things."""
    for m in modules:
        importlib.import_module(m)


def by_row(function: Callable[[dict], dict | None], schema: str, strict: bool = True) -> Callable[[DataFrame], DataFrame]:
    """A preprocessor from a function of one row; a row for which it returns None is dropped. Runs over Arrow batches.

    Where the function raises, the query fails, or without ``strict`` the row is dropped.
    """

    def tried(row: dict) -> dict | None:
        try:
            return function(row)
        except Exception:
            if strict:
                raise
            return None

    def run(df: DataFrame) -> DataFrame:
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [r for x in batch.to_pylist() if (r := tried(x)) is not None]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        arrow = to_arrow_schema(StructType.fromDDL(schema))
        return df.mapInArrow(over, schema)

    return run


def by_batch(function: Callable[[dict[str, list]], dict[str, list]], schema: str) -> Callable[[DataFrame], DataFrame]:
    """A preprocessor from a function of a batch of columns; the number of rows may change."""

    def run(df: DataFrame) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        arrow = to_arrow_schema(StructType.fromDDL(schema))

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_pydict(function(batch.to_pydict()), schema=arrow)

        return df.mapInArrow(over, schema)

    return run


@preprocessor("query_response")
def query_response(df: DataFrame) -> DataFrame:
    """Rows of query, response (and system) as messages; rows without a response are dropped."""
    system = F.col("system") if "system" in df.columns else F.lit(None).cast("string")
    messages = M.with_system(F.array(M.message("user", F.col("query")), M.message("assistant", F.col("response"))), system)
    return df.where("response IS NOT NULL").withColumn("messages", messages).drop("query", "response", "system")


@preprocessor("instruction")
def instruction(df: DataFrame) -> DataFrame:
    """Rows of instruction, input and output as messages."""
    asked = F.concat_ws("\n", F.nullif(F.col("instruction"), F.lit("")), F.nullif(F.col("input"), F.lit("")))
    return df.where("output IS NOT NULL").withColumn("messages", F.array(M.message("user", asked), M.message("assistant", F.col("output")))).drop("instruction", "input", "output")


@sampler("sample")
def sample(df: DataFrame, **options) -> DataFrame:
    from tessera.operators.sampling import best_of_n

    return best_of_n(df, "id", "choices", "orm", "prm", **options)


@sampler("distill")
def distill(df: DataFrame, **_) -> DataFrame:
    """Every answer as a training row of its own."""
    return df.where("choices IS NOT NULL").select("id", F.posexplode("choices").alias("chosen_pos", "chosen"))


@scheduler("accuracy_tip")
class AccuracyTip:
    """Goes on with a tip while an answer is wrong, not cut off by length, and has no tip yet."""

    tip = " But wait... It seems I made a mistake,"

    def finished(self) -> Column:
        return (F.col("finish_reason") == "length") | F.contains(F.col("response"), F.lit(self.tip)) | (F.col("accuracy") == 1)

    def step(self) -> Column:
        return M.cut_for_retry(F.col("response"), self.tip)


def run_turns(df: DataFrame, scheduler_name: str, respond: Callable[[DataFrame], DataFrame], max_turns: int = 8) -> DataFrame:
    """Rows ``id, response, finish_reason, accuracy`` taken turn by turn until their scheduler is done.

    Rows that aren't finished after ``max_turns`` turns come out as they are then: the limit is a part of the schedule, as a
    model's answers needn't ever satisfy it. ``respond`` maps the rows that go on to their next state, with the same columns (a join with a table of
    responses, say). Each turn works only on what isn't finished.
    """
    s = SCHEDULERS[scheduler_name]()
    done, now = [], df
    for _ in range(max_turns):
        now = staged(now)
        ended = F.coalesce(s.finished(), F.lit(False))
        done.append(now.where(ended))
        now = now.where(~ended)
        if not now.head(1):
            break
        now = respond(now.withColumn("response", s.step()))
    else:
        done.append(now)
    union = done[0]
    for d in done[1:]:
        union = union.unionByName(d)
    return union
