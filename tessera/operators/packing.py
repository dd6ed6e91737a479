"""Packing of encoded rows into bins of constant volume, by shards."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def _pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity, shard = int(pdf["capacity"].iloc[0]), int(pdf["shard"].iloc[0])
    pdf = pdf.sort_values(["length", "id"], ascending=[False, True]).reset_index(drop=True)
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    bins, opened = [], 0
    for n in pdf["length"].tolist():
        at = bisect_left(rooms, (n, -1))
        if at == len(rooms):
            number, room = opened, capacity
            opened += 1
        else:
            room, number = rooms.pop(at)
        bins.append(number)
        insort(rooms, (room - n, number))
    return pdf.assign(bin=[f"{shard}-{b}" for b in bins])[["id", "length", "bin"]]


def pack_rows(df: DataFrame, id_column: str, length: str | Column, capacity: int, shards: int | None = None, rows_per_shard: int = 20_000, overlong: bool = False) -> DataFrame:
    """``id, length, bin``: rows put into bins of at most ``capacity``, best-fit decreasing within shards of bounded size.

    Rows longer than the capacity are dropped, or with ``overlong`` have a bin each of their own. Rows without a length
    (NULL or 0) are dropped.
    """
    size = F.col(length) if isinstance(length, str) else length
    rows = df.select(F.col(id_column).cast("long").alias("id"), size.cast("long").alias("length")).where(F.col("length") >= 1)
    if not overlong:
        rows = rows.where(F.col("length") <= capacity)
    n = shards or max(1, -(-rows.count() // rows_per_shard))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("capacity", F.lit(capacity))
    return dealt.groupBy("shard").applyInPandas(_pack_shard, "id long, length long, bin string")
