"""Order-dependent operators on long series, without gathering a series in one task.

A series (all rows of a key) is cut into ranges of the order. Each range is folded by itself; its fold is carried
to the next ones over one row a range; then the rows of a range get their values. A hot key is just many ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.runtime import staged


def _ranged(df: DataFrame, key: str, order: str) -> DataFrame:
    return staged(df.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()))


def running(df: DataFrame, key: str, order: str, value: str, kind: str = "max", before: bool = False, name: str = "running") -> DataFrame:
    """Adds the running 'max', 'min', 'sum' or 'count' of ``value`` by key in ascending order; ``before`` leaves the row itself out."""
    fold = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count}[kind]
    merge = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.sum}[kind]
    both = {"max": F.greatest, "min": F.least}.get(kind, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    ranged = _ranged(df, key, order)
    parts = ranged.groupBy(key, "_part").agg(fold(value).alias("_f"))
    carried = parts.select(key, "_part", merge("_f").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    inside = fold(value).over(Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    return ranged.withColumn("_in", inside).join(carried, [key, "_part"]).withColumn(name, both(F.col("_carry"), F.col("_in"))).drop("_part", "_in", "_carry")


def smoothed(df: DataFrame, key: str, order: str, value: str, smooth: float = 0.9, name: str = "smoothed") -> DataFrame:
    """Adds the debiased exponential average: x = x * smooth + v, divided by the sum of its weights. NULL values are left out.

    Each range of rows is folded on its own, beginning at 0; what a range ends with is carried to the next ones over one
    element for each range, and added to its rows with the weight that is left of it there.
    """
    rows = df.where(F.col(value).isNotNull())
    ranged = rows.repartitionByRange(key, order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(key, order)
    names = [*rows.columns, "_part"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema), "_x double", "_i long"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, x, i = None, 0.0, 0
        for pdf in batches:
            keys, values = pdf[key].tolist(), pdf[value].astype(float).tolist()
            xs, places = [], []
            for k, v in zip(keys, values):
                if k != held or i == 0:
                    held, x, i = k, 0.0, 0
                x = x * smooth + v
                i += 1
                xs.append(x)
                places.append(i)
            yield pdf[names].assign(_x=xs, _i=places)

    local = staged(ranged.mapInPandas(fold, schema))
    ends = local.groupBy(key, "_part").agg(F.max_by("_x", "_i").alias("_end"), F.max("_i").alias("_n"))
    chain = ends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_part", "_end", "_n"))).alias("s"))  # one element a range
    carried = F.aggregate(
        "s",
        F.struct(F.lit(0.0).alias("x"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<_part:int,_carry:double,_before:bigint>>").alias("out")),
        lambda a, e: F.struct(
            (a["x"] * F.pow(F.lit(smooth), e["_n"]) + e["_end"]).alias("x"), (a["n"] + e["_n"]).alias("n"), F.concat(a["out"], F.array(F.struct(e["_part"].alias("_part"), a["x"].alias("_carry"), a["n"].alias("_before")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    starts = chain.select(key, F.explode(carried).alias("c")).select(key, "c._part", "c._carry", "c._before")
    weight = (1 - F.pow(F.lit(smooth), F.col("_before") + F.col("_i"))) / (1 - smooth)
    value_ = (F.col("_x") + F.col("_carry") * F.pow(F.lit(smooth), F.col("_i"))) / weight
    return local.join(starts, [key, "_part"]).withColumn(name, value_).drop("_part", "_i", "_x", "_carry", "_before")


def spikes(df: DataFrame, key: str, order: str, value: str, factor: float = 10.0) -> DataFrame:
    """Adds ``is_invalid`` (NaN or infinite) and ``is_spike``: above ``factor`` times the largest valid value so far."""
    valid = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    made = running(df.withColumn("_v", valid), key, order, "_v", "max", before=True, name="_top")
    return made.withColumns({"is_invalid": F.coalesce(F.col("_v").isNull() & F.col(value).isNotNull(), F.lit(False)), "is_spike": F.coalesce(F.col("_v") > factor * F.col("_top"), F.lit(False))}).drop("_v", "_top")


def stalls(df: DataFrame, key: str, order: str, value: str, patience: int = 3, greater_is_better: bool = True) -> DataFrame:
    """Adds ``stalled`` (saves so far that didn't improve on the best, never reset) and ``stop`` (``patience`` reached)."""
    sign = 1 if greater_is_better else -1
    best = running(df.withColumn("_v", F.col(value) * sign), key, order, "_v", "max", before=True, name="_best")
    flagged = best.withColumn("_flag", F.when(F.col("_best").isNotNull() & ~F.coalesce(F.col("_v") > F.col("_best"), F.lit(False)), 1).otherwise(0))
    return running(flagged, key, order, "_flag", "sum", name="stalled").withColumn("stop", F.col("stalled") >= patience).drop("_v", "_best", "_flag")


def marker_parity(df: DataFrame, keys: list[str], order: str, is_marker: Column) -> DataFrame:
    """Lines between an odd marker and the next, markers left out. A key's lines must fit a task (they are of one document)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_m", is_marker).withColumn("_n", F.sum(F.col("_m").cast("int")).over(w)).where(~F.col("_m") & (F.col("_n") % 2 == 1)).drop("_m", "_n")


def indented_blocks(df: DataFrame, keys: list[str], order: str, line: str) -> DataFrame:
    """Runs of consecutive indented lines, joined by newlines: ``keys, block_no, block``."""
    w = Window.partitionBy(*keys).orderBy(order)
    indented = F.col(line).rlike(r"^[ \t]+\S")
    flagged = df.withColumn("_in", indented).withColumn("_new", (F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False))).cast("int"))
    numbered = flagged.withColumn("block_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_in")
    return numbered.groupBy(*keys, "block_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))), lambda x: x["l"]), "\n").alias("block"))
