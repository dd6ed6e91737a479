"""Writers. All go through Spark's committers, so that a lost task leaves no half-written output."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, functions as F

from tessera.operators import sampling
from tessera.runtime import staged


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a line, non-ASCII as it is, NULL fields left out; ``mode`` 'append' adds to what is there."""
    df.write.mode(mode).json(path)


def answers(df: DataFrame, question_id: str, choices: Column, model_id: str) -> DataFrame:
    """Rows of an answer file: question, a new answer id, the model, the choices and the time of writing."""
    return df.select(F.col(question_id).alias("question_id"), F.replace(F.uuid(), F.lit("-"), F.lit("")).alias("answer_id"), F.lit(model_id).alias("model_id"), choices.alias("choices"), F.unix_timestamp().alias("tstamp"))


def result_row(task: str, requests: DataFrame, latency: Column, backend: str = "spark", num_gpus: int = 1, **other) -> DataFrame:
    """One row for a run: throughput and accept length rounded to three digits, settings nested in ``other``."""
    tokens, verified = F.sum("completion_tokens"), F.sum("spec_verify_ct")
    settings = F.struct(*[F.lit(v).alias(k) for k, v in other.items()]) if other else F.struct(F.lit(None).cast("string").alias("none"))
    return requests.agg(
        F.lit(task).alias("task"), F.lit(backend).alias("backend"), F.lit(num_gpus).alias("num_gpus"), F.round(latency, 3).alias("latency"), F.round(F.try_divide(tokens, latency), 3).alias("throughput"),
        F.round(F.coalesce(F.try_divide(tokens, verified), F.lit(1.0)), 3).alias("accept_length"), F.count(F.lit(1)).alias("num_requests"), settings.alias("other"),
    )


def safe_name(category: Column) -> Column:
    """A category as a folder name."""
    return F.translate(category, "/ ", "__")


def by_category(df: DataFrame, category: str, path: str, mode: str = "overwrite") -> None:
    df.withColumn("_folder", safe_name(F.col(category))).write.mode(mode).partitionBy("_folder").json(path)


def sharded(df: DataFrame, path: str, rows_per_file: int) -> None:
    """Parquet in files of bounded size: its footers take the place of an offset index."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def indexed(df: DataFrame, path: str, order: str, rows_per_file: int = 1_000_000) -> None:
    """Rows numbered from 0 in ``order`` and written in that order, so that ``readers.rows_at`` finds a row by its number.

    The least and largest number that each file and row group states are the index: a reader opens only what holds the
    numbers it wants.
    """
    sampling.numbered(df, order, name="row_no").repartitionByRange("row_no").sortWithinPartitions("row_no").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def resumable(df: DataFrame, path: str, id_column: str) -> int:
    """Append the rows whose id isn't in the output yet; returns how many were written. Running it again writes nothing."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    exists = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    todo = df.join(spark.read.parquet(path).select(id_column).distinct(), id_column, "left_anti") if exists else df
    n = todo.count()
    if n:
        todo.write.mode("append").parquet(path)
    return n


def set_aside(spark, path: str) -> str | None:
    """Rename an existing output to the same name with the time appended; returns the new name."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return None
    moved = f"{path.rstrip('/')}.{int(time.time())}"
    system.rename(where, hadoop.Path(moved))
    return moved


def jdbc(df: DataFrame, url: str, table: str, **properties: str) -> None:
    """Append to a relational table."""
    df.write.jdbc(url, table, mode="append", properties=properties)


def new_keys(runs: DataFrame, stored: DataFrame | None, order: str, key: str = "benchmark_id") -> DataFrame:
    """``runs`` with keys that go on from the largest one stored: what inserting rows one by one would return."""
    last = -1 if stored is None else stored.agg(F.max(key)).first()[0]
    return sampling.numbered(runs, order, name=key).withColumn(key, F.col(key) + (0 if last is None else last + 1))


def benchmark_store(runs: DataFrame, devices: DataFrame, measures: DataFrame, path: str, order: str | None = None) -> DataFrame:
    """The three tables of a benchmark store, appended as Parquet; nested values as JSON text. Returns the runs as stored.

    With ``order`` (a column that all three tables share and that names a run) each run gets a new ``benchmark_id``, which
    the rows of the other tables take over.
    """
    if order is not None:
        spark = runs.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        where = hadoop.Path(f"{path}/benchmarks")
        exists = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        runs = staged(new_keys(runs, spark.read.parquet(f"{path}/benchmarks") if exists else None, order))
        devices, measures = (df.join(runs.select(order, "benchmark_id"), order) for df in (devices, measures))
    for name, df in (("benchmarks", runs), ("device_measurements", devices), ("model_measurements", measures)):
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("struct", "map", "array")]
        df.withColumns({c: F.to_json(c) for c in nested}).write.mode("append").parquet(f"{path}/{name}")
    return runs
