"""Named pipelines: from files to files, with a report of what each stage did."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import text as T
from tessera.operators import clean as C, messages as M, packing, sampling
from tessera.runtime import staged
from tessera.sources import readers, sinks


def length_stats(pairs: DataFrame) -> DataFrame:
    """Least, largest and mean length of prompts and responses; NULL for an empty corpus."""
    made = [F.count(F.lit(1)).alias("n")]
    for c in ("prompt", "response"):
        n = F.length(c).cast("long")
        made += [F.min(n).alias(f"{c}_min"), F.max(n).alias(f"{c}_max"), F.avg(n).alias(f"{c}_avg")]
    return pairs.agg(*made)


def clean_files(spark: SparkSession, source: str, target: str, threshold: float | None = None) -> DataFrame:
    """Read chat JSON lines, clean them, write the kept ones as JSON lines; returns ``outcome, n``.

    Rows are numbered by file and place, which decides which one of duplicates is the first. Malformed lines are
    left out and counted as 'malformed', rows without a pair as 'no_pair'.
    """
    lines = spark.read.text(source).select("value", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_place"))
    numbered = staged(sampling.numbered(lines, "_file", "_place", name="row_id").drop("_file", "_place"))
    good, bad = readers.parsed_lines(numbered, "value")
    pairs = staged(C.pair_by_position(good.select("row_id", "messages")))
    outcome = C.clean(pairs.select("row_id", "prompt", "response"), "row_id", **({} if threshold is None else {"threshold": threshold})).withColumnRenamed("id", "row_id")
    outcome = staged(outcome)
    kept = pairs.join(outcome.where("outcome = 'kept'").select("row_id"), "row_id").select("messages")
    sinks.jsonl(kept, target)
    counts = outcome.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    broken = bad.agg(F.lit("malformed").alias("outcome"), F.count(F.lit(1)).alias("n"))
    without = good.where(~(F.size("messages") >= 2) | F.col("messages").isNull()).agg(F.lit("no_pair").alias("outcome"), F.count(F.lit(1)).alias("n"))
    return counts.unionByName(broken).unionByName(without)


def training_rows(df: DataFrame, id_column: str, template: str, capacity: int, system: str | None = None) -> DataFrame:
    """``id, text, length, bin``: conversations rendered in a template and packed into bins of ``capacity`` words.

    The length is the number of words; give a table with another length to ``operators.packing.pack_rows`` for
    a tokenizer's. Conversations longer than the capacity are dropped.
    """
    m = F.col("messages") if system is None else M.with_system(F.col("messages"), F.lit(system))
    rendered = staged(df.where(F.size("messages") > 0).select(F.col(id_column).cast("long").alias("id"), M.rendered(m, M.get_template(template)).alias("text")).withColumn("length", F.size(T.words(F.col("text"))).cast("long")))
    bins = packing.pack_rows(rendered, "id", "length", capacity).select("id", "bin")
    return rendered.join(bins, "id")
