"""Operators on encoded rows: arrays of token ids and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import arrays as A
from tessera.runtime import staged


def over_length(df: DataFrame, column: str, limit: int, strategy: str = "delete") -> DataFrame:
    """Rows longer than ``limit``: dropped ('delete') or cut at the left or right end. NULL arrays are dropped by 'delete', else kept."""
    c = F.col(column)
    if strategy == "delete":
        return df.where(F.size(c) <= limit).where(c.isNotNull())
    if strategy == "right":
        return df.withColumn(column, F.slice(c, 1, limit))
    if strategy == "left":
        return df.withColumn(column, F.when(F.size(c) > limit, F.slice(c, F.size(c) - limit + 1, F.lit(limit))).otherwise(c))
    raise ValueError(f"unknown strategy {strategy}")


def token_accuracy(df: DataFrame, id_column: str, predictions: str, labels: str) -> DataFrame:
    """``id, correct, counted, all_correct``: predictions for the next token against labels shifted by one, ignored ones left out."""
    shifted = F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0)))
    pairs = F.filter(F.zip_with(predictions, shifted, lambda p, y: F.struct(p.alias("p"), y.alias("y"))), lambda z: z["y"].isNotNull() & (z["y"] != A.IGNORED))
    judged = df.where(F.col(predictions).isNotNull() & F.col(labels).isNotNull()).select(F.col(id_column).alias("id"), pairs.alias("z"))
    correct = F.size(F.filter("z", lambda z: F.coalesce(z["p"] == z["y"], F.lit(False))))
    return judged.select("id", correct.alias("correct"), F.size("z").alias("counted"), (correct == F.size("z")).alias("all_correct"))


def fixed_blocks(df: DataFrame, order: str, column: str, block: int) -> DataFrame:
    """``block_no, tokens``: all arrays one after the other by ``order``, cut into blocks of equal size; the rest is dropped.

    At least one block comes out as long as there is any token: with fewer tokens than a block it is short. Offsets
    come from a running sum over rows, computed from sums of ranges of rows so that no task sees all rows.
    """
    rows = df.where(F.size(column) > 0).select(F.col(order).alias("_o"), F.col(column).alias("_a"), F.size(column).cast("long").alias("_n"))
    offsets = running_total(rows.select("_o", "_n"), "_o", "_n").withColumnRenamed("total", "_end")
    placed = rows.join(offsets.select("_o", "_end"), "_o").select((F.col("_end") - F.col("_n")).alias("_start"), "_a")
    total = rows.agg(F.sum("_n")).first()[0] or 0
    blocks = max(total // block, 1)
    # each array is cut where blocks begin; its pieces, not its tokens, meet
    first, last = F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.size("_a") - 1) / block)
    numbered = placed.select("_start", "_a", F.explode(F.sequence(first, last)).alias("block_no")).where(F.col("block_no") < blocks)
    begin = F.greatest(F.col("block_no") * block - F.col("_start"), F.lit(0)).cast("int")
    end = F.least((F.col("block_no") + 1) * block - F.col("_start"), F.size("_a").cast("long")).cast("int")
    pieces = numbered.select("block_no", (F.col("_start") + begin).alias("at"), F.slice("_a", begin + 1, end - begin).alias("piece"))
    return pieces.groupBy("block_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"])).alias("tokens"))


def running_total(df: DataFrame, order: str, value: str) -> DataFrame:
    """``order, total``: running sum of ``value`` in ascending ``order`` (unique), without a window over all rows.

    Rows are range-partitioned; each range is summed by itself and begins where the ranges before it end.
    """
    ranged = df.select(order, value).repartitionByRange(order).withColumn("_part", F.spark_partition_id())
    ranged = staged(ranged)
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))  # one row for each range
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("_part", before.alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(F.broadcast(starts), "_part").select(order, (F.col("_before") + inside).alias("total"))


def segments_of(positions: Column) -> Column:
    """Lengths of the segments of a packed sequence: a position id of 0 starts one."""
    return F.when(
        F.size(positions) > 0,
        F.zip_with(
            F.filter(F.transform(positions, lambda p, i: F.when(p == 0, i)), lambda i: i.isNotNull()),
            F.concat(F.slice(F.filter(F.transform(positions, lambda p, i: F.when(p == 0, i)), lambda i: i.isNotNull()), F.lit(2), F.size(positions)), F.array(F.size(positions))),
            lambda a, b: b - a,
        ),
    )


def zigzag(array: Column, ranks: int, rank: int) -> Column:
    """Chunks ``rank`` and ``2 * ranks - 1 - rank`` of an array cut into 2 * ranks equal chunks."""
    width = F.floor(F.size(array) / (2 * ranks)).cast("int")
    return F.concat(F.slice(array, rank * width + 1, width), F.slice(array, (2 * ranks - 1 - rank) * width + 1, width))


def padded_to_multiple(array: Column, n: int, fill: Column) -> Column:
    """Padded at the right until the size is a multiple of n."""
    return F.concat(array, F.array_repeat(fill, F.pmod(-F.size(array), F.lit(n))))


def rank_slice(array: Column, ranks: int, rank: int) -> Column:
    """The rank-th of ``ranks`` equal parts of an array whose size is a multiple of ``ranks``."""
    width = (F.size(array) / ranks).cast("int")
    return F.slice(array, rank * width + 1, width)
