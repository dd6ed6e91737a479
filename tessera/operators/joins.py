"""Joins that Spark has no operator for: nearest earlier row, and intervals. Hot keys are split by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], bucket: float) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time (numeric).

    Both sides are laid on one timeline in buckets; a row looks within its own bucket first, and else takes what the
    buckets before carried over, so that no task sees more than a bucket of a key. Ties take the row with the larger
    values. NULL keys or times match nothing; left rows without a match keep NULLs.
    """
    names = left.columns
    a = left.select(F.struct(*names).alias("_l"), F.col(key).alias("_k"), F.col(time).cast("double").alias("_t"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("_v"), F.lit(1).alias("_side"))
    b = right.where(F.col(time).isNotNull() & F.col(key).isNotNull()).select(F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.col(key).alias("_k"), F.col(time).cast("double").alias("_t"), F.struct(*values).alias("_v"), F.lit(0).alias("_side"))
    line = a.unionByName(b).withColumn("_b", F.floor(F.col("_t") / bucket))
    ends = b.groupBy("_k", F.floor(F.col("_t") / bucket).alias("_b")).agg(F.max_by("_v", F.struct("_t", "_v")).alias("_e"))
    buckets = line.where("_side = 1").select("_k", "_b").distinct().join(ends, ["_k", "_b"], "full")
    carried = buckets.select("_k", "_b", F.last("_e", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    inside = F.last("_v", ignorenulls=True).over(Window.partitionBy("_k", "_b").orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0))
    found = line.withColumn("_in", inside).where("_side = 1").join(carried, ["_k", "_b"], "left")
    best = F.coalesce("_in", "_c")
    return found.select(*[F.col("_l")[c].alias(c) for c in names], *[best[v].alias(v if v not in names else f"right_{v}") for v in values])


def within(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Left rows with every right interval [low, high) that holds their point, by equi-join on buckets of a width."""
    a = left.withColumn("_b", F.floor(F.col(point) / width))
    b = right.where(F.col(high) > F.col(low)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return a.join(b, "_b").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_b")


def with_default(df: DataFrame, dim: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """Left join on a key; a default where the dimension lacks it or has NULL. Of several values of a key the least counts."""
    return df.join(dim.groupBy(key).agg(F.min(value).alias(value)), key, "left").withColumn(value, F.coalesce(value, default))
