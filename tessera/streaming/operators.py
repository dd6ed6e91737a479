"""Stateful and windowed operators on streams."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def usage_totals(stream: DataFrame, id_column: str, *keys: str) -> DataFrame:
    """Requests and tokens by key, each request counted once (its first delivery)."""
    once = stream.dropDuplicates([id_column])
    return once.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


def windowed(stream: DataFrame, time: str, width: str, slide: str | None, lateness: str, *keys: str) -> DataFrame:
    """Counts by (sliding) event-time window and key; later rows than ``lateness`` are dropped where the output is appended."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, lateness).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, time: str, gap: str, lateness: str, key: str) -> DataFrame:
    """Sessions of a key: rows closer than a gap."""
    return stream.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def deduplicated(stream: DataFrame, id_column: str, time: str, lateness: str) -> DataFrame:
    """The first row of each id, with state only for ids within the lateness."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([id_column])


def enriched(stream: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """A stream joined to a table on a key; rows without a match keep NULLs."""
    return stream.join(static, key, "left")


#: Rows that are packed together at most; a shard's rows of one batch come in groups of so many.
PACKED_AT_ONCE = 5_000


def packed(stream: DataFrame, id_column: str, length: str | Column, capacity: int, shards: int | None = None, overlong: bool = False, rest: bool = False) -> DataFrame:
    """``id, length, shard, bin``: rows packed best-fit decreasing as they arrive; the emptiest bin is carried over.

    Each group of rows of a shard (``shards``: as many as shuffle partitions by default) is packed together with the
    carried ones, and all bins but the one with most room come out. A stream without end never knows its last bin: with
    ``rest`` each batch gives the rows that wait as well, numbered in ``rest`` (0 for bins that are done); ``closed_rows``
    keeps the last. Rows longer than the capacity are dropped, or with ``overlong`` have a bin each of their own. Rows
    without a length (NULL or 0) are dropped.
    """

    def place(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, batch, ids, sizes = state.get if state.exists else (0, 0, [], [])
        ids, sizes, out = list(ids), list(sizes), []
        for pdf in batches:
            for at in range(0, len(pdf), PACKED_AT_ONCE):
                part = pdf.iloc[at : at + PACKED_AT_ONCE]
                pool = sorted(zip(sizes + part["length"].tolist(), ids + part["id"].tolist()), key=lambda x: (-x[0], x[1]))
                bins: list[list[tuple[int, int]]] = []
                rooms: list[tuple[int, int]] = []  # (room, bin), ascending
                for n, i in pool:
                    fit = bisect_left(rooms, (n, -1))
                    if fit == len(rooms):
                        room, b = capacity, len(bins)
                        bins.append([])
                    else:
                        room, b = rooms.pop(fit)
                    bins[b].append((i, n))
                    insort(rooms, (room - n, b))
                carried = rooms[-1][1] if rooms and rooms[-1][0] > 0 else -1
                for b, own in enumerate(bins):
                    if b != carried:
                        out += [(i, n, key[0], number, 0) for i, n in own]
                        number += 1
                ids, sizes = ([i for i, _ in bins[carried]], [n for _, n in bins[carried]]) if carried >= 0 else ([], [])
        state.update((number, batch + 1, ids, sizes))
        if rest:
            out += [(i, n, key[0], number, batch + 1) for i, n in zip(ids, sizes)] or [(None, None, key[0], number, batch + 1)]
        made = pd.DataFrame(out, columns=["id", "length", "shard", "bin", "rest"]).astype({"id": "Int64", "length": "Int64"})
        yield made if rest else made.drop(columns="rest")

    size = F.col(length) if isinstance(length, str) else length
    rows = stream.select(F.col(id_column).cast("long").alias("id"), size.cast("long").alias("length")).where(F.col("length") >= 1)
    if not overlong:
        rows = rows.where(F.col("length") <= capacity)
    n = shards or int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    schema = "id long, length long, shard int, bin long" + ", rest long" * rest
    return dealt.groupBy("shard").applyInPandasWithState(place, schema, "number long, batch long, ids array<long>, sizes array<long>", "append", GroupStateTimeout.NoTimeout)


def closed_rows(df: DataFrame, key: str, value: str) -> DataFrame:
    """The drained rows of ``packed`` with ``rest``: those of finished bins, and those that each key still had at the end."""
    last = df.where("rest > 0").groupBy(key).agg(F.max("rest").alias("rest"))
    waiting = df.join(last, [key, "rest"]).where(F.col(value).isNotNull())
    return df.where("rest = 0").unionByName(waiting).drop("rest")


def chunk(text: str, size: int, left: int, right: int) -> list[tuple[str, int, int]]:
    """Overlapping chunks of a text: (chunk, left stride, right stride); the last one may be shorter."""
    if left + right >= size:
        raise ValueError("the strides must be shorter than the chunk")
    out, stride = [], 0
    while len(text) >= size:
        out.append((text[:size], stride, right))
        stride = left
        text = text[size - left - right :]
    if len(text) > left:
        out.append((text, stride, 0))
    return out


def chunks(text: Column, size: int, left: int, right: int) -> Column:
    """The same as an expression: ``array<struct<chunk, left, right>>``."""
    if left + right >= size:
        raise ValueError("the strides must be shorter than the chunk")
    step = size - left - right
    n = F.length(text)
    whole = F.when(n >= size, F.floor((n - size) / step) + 1).otherwise(0).cast("int")
    full = F.when(
        whole > 0,
        F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.struct(F.substring(text, i * step + 1, F.lit(size)).alias("chunk"), F.when(i == 0, 0).otherwise(left).alias("left"), F.lit(right).alias("right"))),
    ).otherwise(F.array().cast("array<struct<chunk:string,left:int,right:int>>"))
    rest = F.substring(text, whole * step + 1, n)
    tail = F.when(F.length(rest) > left, F.array(F.struct(rest.alias("chunk"), F.when(whole == 0, 0).otherwise(left).alias("left"), F.lit(0).alias("right")))).otherwise(F.array().cast("array<struct<chunk:string,left:int,right:int>>"))
    return F.when(text.isNotNull(), F.concat(full, tail))


def closed(df: DataFrame, value: str) -> DataFrame:
    """The drained rows of ``chunked`` or ``emitted`` with ``rest``: what was finished, and what each key still had at the end."""
    names = [c for c in df.columns if c not in ("key", "rest")]
    last = df.where("rest > 0").groupBy("key").agg(F.max_by(F.struct(*names), "rest").alias("last")).select("key", "last.*").where(F.col(value).isNotNull())
    return df.where("rest = 0").drop("rest").unionByName(last)


def chunked(stream: DataFrame, key: str, text: str, size: int, left: int, right: int, rest: bool = False) -> DataFrame:
    """``key, chunk, left, right`` of texts that arrive in pieces; what is too short for a chunk waits in the state.

    A stream without end never knows its last chunk. With ``rest`` each batch gives one more row a key, what is waiting
    (NULL if ``chunk`` makes no last chunk of it), numbered in ``rest``, which is 0 for whole chunks; ``closed`` keeps the last.
    """
    if left + right >= size:
        raise ValueError("the strides must be shorter than the chunk")

    def cut(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, stride, number = state.get if state.exists else ("", 0, 0)
        out = []
        for pdf in batches:
            for piece in pdf["piece"]:
                waiting += piece or ""
                while len(waiting) >= size:
                    out.append((k[0], waiting[:size], stride, right, 0))
                    stride = left
                    waiting = waiting[size - left - right :]
        state.update((waiting, stride, number + 1))
        if rest:
            out.append((k[0], waiting if len(waiting) > left else None, stride, 0, number + 1))
        made = pd.DataFrame(out, columns=["key", "chunk", "left", "right", "rest"])
        yield made if rest else made.drop(columns="rest")

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(text).alias("piece"))
    return rows.groupBy("key").applyInPandasWithState(cut, "key string, chunk string, left int, right int" + ", rest long" * rest, "waiting string, stride int, number long", "append", GroupStateTimeout.NoTimeout)


def emitted(stream: DataFrame, key: str, token: str, rest: bool = False) -> DataFrame:
    """``key, text``: tokens gathered until a word or line is complete, a CJK character at once; the rest waits in the state.

    With ``rest`` each batch gives what is waiting as well, as in ``chunked``.
    """

    def emit(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, number = state.get if state.exists else ("", 0)
        out = []
        for pdf in batches:
            for piece in pdf["piece"]:
                waiting += piece or ""
                if waiting.endswith("\n") or (waiting and "一" <= waiting[-1] <= "鿿"):
                    cut = len(waiting)
                else:
                    cut = waiting.rfind(" ") + 1
                if cut:
                    out.append((k[0], waiting[:cut], 0))
                    waiting = waiting[cut:]
        state.update((waiting, number + 1))
        if rest:
            out.append((k[0], waiting or None, number + 1))
        made = pd.DataFrame(out, columns=["key", "text", "rest"])
        yield made if rest else made.drop(columns="rest")

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(token).alias("piece"))
    return rows.groupBy("key").applyInPandasWithState(emit, "key string, text string" + ", rest long" * rest, "waiting string, number long", "append", GroupStateTimeout.NoTimeout)
