"""Problem 6: filling containers of fixed capacity.

Method: bound-certified repacking. Items are dealt into partitions of bounded size; each is packed by best-fit
decreasing. Dual-feasible functions give a lower bound on a partition's bins: where the bound is met, the
packing is certified optimal and left alone. Partitions with a gap give up the bins that are not full; the pooled
documents are dealt into new partitions of bounded size and packed again by best-fit decreasing. A partition's new
packing is taken only where it has fewer bins, so no round makes more of them. Rounds go on until every partition is
certified or a round saves no bin. The same functions bound the rows of a whole plan, from counts by size; ``bounds``
reports how many rows are above that.

An item larger than the capacity is the only one to be split: into full containers and one remainder, which is
packed like any other item.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.runtime import staged, table

#: Items of one partition, about.
PARTITION_ITEMS = 5_000
#: Plans taken at once: rows of a small table; more raise an error.
MAX_PLANS = 1_000


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: largest first (ties in the order given), each into the fullest bin with room."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), dtype=np.int64)
    rooms: list[int] = []  # distinct rooms of open bins, ascending
    held: dict[int, list[int]] = {}  # room -> bins
    opened = 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            stack = held[room]
            b = stack.pop()
            if not stack:
                del held[room], rooms[at]
        else:
            b, room = opened, capacity
            opened += 1
        bins[i] = b
        room -= size
        if room:
            if room in held:
                held[room].append(b)
            else:
                held[room] = [b]
                insort(rooms, room)
    return bins


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that no packing of these sizes can do without."""
    return counted_bound(*np.unique(sizes, return_counts=True), capacity)


def counted_bound(values: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Bins that no packing can do without, by dual-feasible functions, from sizes and how many items have each.

    The identity (total size), and for thresholds t up to half the capacity the function that counts items above
    capacity - t as whole bins, drops those below t and leaves the others; and rounding functions for small k.
    """
    if not len(values):
        return 0
    order = np.argsort(values)
    values, counts = values[order], counts[order]
    best = -(-int((values * counts).sum()) // capacity)
    total = np.r_[0, np.cumsum(values * counts)]
    number = np.r_[0, np.cumsum(counts)]
    t = np.unique(np.r_[values[2 * values <= capacity], capacity - values[2 * values > capacity], 1])
    t = t[(t > 0) & (2 * t <= capacity)]
    if len(t):
        low, high = np.searchsorted(values, t), np.searchsorted(values, capacity - t, side="right")
        best = max(best, int((number[-1] - number[high] - (-(total[high] - total[low]) // capacity)).max()))
    for k in range(1, 20):  # u_k(x) = x where (k + 1) x is a multiple of the capacity, else floor((k + 1) x) / k
        scaled = (k + 1) * values
        exact = scaled % capacity == 0
        # in units of capacity * k
        weight = np.where(exact, values * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((weight * counts).sum()) // (capacity * k)))
    return best


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pack one partition. Keeps the bins it came with unless the new ones are fewer."""
    pdf = pdf.sort_values(["size", "doc", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    capacity, name = int(pdf["capacity"].iloc[0]), pdf["partition"].iloc[0]
    sizes = pdf["size"].to_numpy(dtype=np.int64)
    bins = best_fit_decreasing(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    old = pdf["bin"]
    if old.notna().all() and old.nunique() <= bins.max() + 1:
        bin_names, used = old.to_numpy(), old.nunique()
    else:
        bin_names, used = np.array([f"{name}-{b}" for b in bins], dtype=object), int(bins.max()) + 1
    fill = pd.Series(sizes).groupby(bin_names).transform("sum")
    return pdf.assign(bin=bin_names, fill=fill.to_numpy(), certified=used == bound)


_SCHEMA = "plan_id int, capacity long, doc long, piece int, size long, partition string, bin string, fill long, certified boolean"


def _plans(plans: DataFrame) -> list:
    """The usable plans, each once."""
    plan = plans.where("plan_id IS NOT NULL AND capacity_tokens >= 1").select(F.col("plan_id").cast("int").alias("plan_id"), F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    rows = plan.limit(MAX_PLANS + 1).collect()
    if len(rows) > MAX_PLANS:
        raise ValueError(f"more than {MAX_PLANS} plans at once")
    return rows


def _of_each_plan(base: DataFrame, plan_rows: list) -> tuple[DataFrame, DataFrame]:
    """The full pieces of items over the capacity, and the items and remainders to be packed, for every plan."""
    struct = F.array(*[F.struct(F.lit(r["plan_id"]).alias("plan_id"), F.lit(r["capacity"]).cast("long").alias("capacity")) for r in plan_rows])
    each = base.select("doc", "size", F.explode(struct).alias("p")).select("p.plan_id", "p.capacity", "doc", "size")
    split = F.col("size") > F.col("capacity")
    full = each.where(split).select("plan_id", "capacity", "doc", F.explode(F.sequence(F.lit(0), (F.col("size") / F.col("capacity")).cast("int") - 1)).alias("piece"))
    loose = each.select(
        "plan_id", "capacity", "doc",
        F.when(split, F.floor(F.col("size") / F.col("capacity"))).otherwise(0).cast("int").alias("piece"),
        F.when(split, F.pmod("size", "capacity")).otherwise(F.col("size")).alias("size"),
    ).where("size > 0")
    return full, loose


def _items(items: DataFrame, id_column: str, size: str) -> DataFrame:
    return items.select(F.col(id_column).cast("long").alias("doc"), F.col(size).cast("long").alias("size")).where("doc IS NOT NULL AND size >= 1")


_RESULT = "plan_id int, row_id string, doc long, piece int, tokens long, row_tokens long, capacity long"


def pack(items: DataFrame, plans: DataFrame, id_column: str, size: str, partition_items: int | None = None) -> DataFrame:
    """``plan_id, row_id, doc, piece, tokens, row_tokens, capacity`` of every item, or piece of an item, in every plan.

    ``plans``: ``plan_id, capacity_tokens``, at most MAX_PLANS. A container (``row_id``, unique within its plan) never
    holds more than the capacity. An item that fits is one piece, number 0; a larger one is split into full pieces and a
    remainder. Items whose id or size is NULL, and sizes below 1, can't be placed and give no rows; neither do plans
    whose capacity is NULL or below 1. Equal items and repeated ids are placed each on its own; ties are decided
    by id. Empty tables give no rows; other columns are ignored, whatever their names.
    """
    partition_items = partition_items or PARTITION_ITEMS
    plan_rows, base = _plans(plans), _items(items, id_column, size)
    if not plan_rows:
        return base.sparkSession.createDataFrame([], _RESULT)
    parts = max(1, -(-base.count() // partition_items))
    full, loose = _of_each_plan(base, plan_rows)
    full = full.select("plan_id", F.concat_ws("-", F.lit("full"), "doc", "piece").alias("row_id"), "doc", "piece", F.col("capacity").alias("tokens"), F.col("capacity").alias("row_tokens"), "capacity")
    cores = base.sparkSession.sparkContext.defaultParallelism

    def packed(df: DataFrame, n: int) -> DataFrame:
        """Groups are dealt over a number of tasks of their own: by their few bytes they would all go to one."""
        tasks = max(1, min(n * len(plan_rows), max(4 * cores, n)))
        return staged(df.repartition(tasks, "plan_id", "partition").groupBy("plan_id", "partition").applyInPandas(_pack, _SCHEMA))

    number = F.pmod(F.xxhash64("doc", "piece"), F.lit(parts)).cast("string")
    state = packed(loose.select("*", F.concat_ws("-", F.lit("r0"), number).alias("partition"), F.lit(None).cast("string").alias("bin"), F.lit(None).cast("long").alias("fill"), F.lit(False).alias("certified")), parts)
    done, round_ = [], 0
    while True:
        open_ = state.where("NOT certified AND fill < capacity")
        before = open_.agg(F.count_distinct("plan_id", "partition").alias("parts"), F.count_distinct("plan_id", "bin").alias("bins"), F.max("size").alias("any")).first()
        if before["parts"] < 2:  # what is left lies in one partition: there is nothing to exchange
            break
        round_ += 1
        sizes = open_.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"))  # one row a plan
        largest = sizes.agg(F.max("n")).first()[0]
        fewer = max(1, -(-largest // partition_items))
        by_bin = F.pmod(F.xxhash64("bin", F.lit(round_)), F.lit(fewer)).cast("string")  # bins stay together
        dealt = open_.withColumn("partition", F.concat_ws("-", F.lit(f"r{round_}"), by_bin))
        done.append(state.where("certified OR fill >= capacity"))
        state = packed(dealt, fewer)
        if state.agg(F.count_distinct("plan_id", "bin")).first()[0] >= before["bins"]:
            break
    done.append(state)
    union = done[0]
    for d in done[1:]:
        union = union.unionByName(d)
    placed = union.select("plan_id", F.col("bin").alias("row_id"), "doc", "piece", F.col("size").alias("tokens"), F.col("fill").alias("row_tokens"), "capacity")
    return placed.unionByName(full)


def _bound(pdf: pd.DataFrame) -> pd.DataFrame:
    sizes, counts = pdf["size"].to_numpy(dtype=np.int64), pdf["n"].to_numpy(dtype=np.int64)
    return pdf[["plan_id"]].head(1).assign(least_rows=counted_bound(sizes, counts, int(pdf["capacity"].iloc[0])))


def bounds(items: DataFrame, plans: DataFrame, id_column: str, size: str) -> DataFrame:
    """``plan_id, least_rows``: rows that no packing of a plan's items can do without, by dual-feasible functions.

    They need only how many items have each size: at most as many numbers as the capacity. Full pieces are rows of their own.
    """
    plan_rows, base = _plans(plans), _items(items, id_column, size)
    if not plan_rows:
        return base.sparkSession.createDataFrame([], "plan_id int, least_rows long")
    full, loose = _of_each_plan(base, plan_rows)
    counted = loose.groupBy("plan_id", "capacity", "size").agg(F.count(F.lit(1)).alias("n"))
    least = counted.groupBy("plan_id").applyInPandas(_bound, "plan_id int, least_rows long")
    return least.unionByName(full.groupBy("plan_id").agg(F.count(F.lit(1)).alias("least_rows"))).groupBy("plan_id").agg(F.sum("least_rows").alias("least_rows"))


def sized_documents(df: DataFrame) -> DataFrame:
    """``doc_id, source, tokens`` of the documents with text; where n_tokens is NULL it is counted: bytes and one end token."""
    return df.where(F.col("text").rlike(r"[^\s\p{Z}\x{85}]")).select("doc_id", "source", F.coalesce("n_tokens", F.octet_length("text") + 1).cast("long").alias("tokens"))


def p6_packed(spark: SparkSession, root: str) -> DataFrame:
    """The training row of every document or piece for every plan, and how full the row is."""
    return pack(sized_documents(table(spark, root, "documents")), table(spark, root, "pack_plans"), "doc_id", "tokens").withColumnRenamed("doc", "doc_id")


def p6_rows(spark: SparkSession, root: str) -> DataFrame:
    """For every plan the number of rows, the bound on it, by how many rows it is missed, and the unused share of the room."""
    items, plans = sized_documents(table(spark, root, "documents")), table(spark, root, "pack_plans")
    placed = pack(items, plans, "doc_id", "tokens")
    rows = placed.groupBy("plan_id", "capacity").agg(F.count_distinct("row_id").alias("rows"), F.sum("tokens").alias("tokens"))
    joined = rows.join(bounds(items, plans, "doc_id", "tokens"), "plan_id")
    return joined.select("plan_id", "capacity", "rows", "least_rows", (F.col("rows") - F.col("least_rows")).alias("gap"), (1 - F.col("tokens") / (F.col("rows") * F.col("capacity"))).alias("unused_share"))


def p6_checked(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of ``p6_packed``: for every plan its pieces, documents and tokens, rows over the capacity or whose
    fill isn't the sum of their pieces, and documents that are split though they fit."""
    placed = staged(p6_packed(spark, root))
    fills = placed.groupBy("plan_id", "row_id").agg(F.sum("tokens").alias("fill"), F.min("row_tokens").alias("low"), F.max("row_tokens").alias("high"), F.max("capacity").alias("capacity"))
    wrong = fills.groupBy("plan_id").agg(F.count_if((F.col("fill") > F.col("capacity")) | (F.col("fill") != F.col("low")) | (F.col("low") != F.col("high"))).alias("wrong_rows"))
    whole = placed.groupBy("plan_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"), F.max("capacity").alias("capacity"))
    docs = whole.groupBy("plan_id").agg(
        F.sum("pieces").alias("pieces"), F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.count_if((F.col("tokens") <= F.col("capacity")) & (F.col("pieces") > 1)).alias("needless_splits")
    )
    return docs.join(wrong, "plan_id")


SQL = {
    "p6_checked": r"""
WITH d AS (SELECT doc_id, coalesce(n_tokens, octet_length(encode(text)) + 1)::BIGINT AS n FROM documents WHERE regexp_matches(text, '[^\s\p{Z}\x{85}\x0b]'))
SELECT plan_id, sum((n + capacity_tokens - 1) // capacity_tokens)::BIGINT AS pieces, count(*) AS documents, sum(n)::BIGINT AS tokens, 0 AS needless_splits, 0 AS wrong_rows
FROM d, pack_plans WHERE n >= 1 GROUP BY plan_id""",
}
