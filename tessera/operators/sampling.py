"""Sampling, splitting, sharding, batching, interleaving and best-of-N selection.

All random choice is by the md5 of an id and a seed: reproducible on any cluster, the same whatever the
partitioning, and equal in any engine with md5. Global ranks come from ranges of the order, never from one window
over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.runtime import staged


def shuffled_order(id_column: str | Column, seed: int) -> Column:
    """A reproducible pseudo-random key."""
    c = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.md5(F.concat_ws("-", c.cast("string"), F.lit(str(seed))))


def unit(id_column: str | Column, seed: int) -> Column:
    """A reproducible pseudo-random number in [0, 1)."""
    return F.conv(F.substring(shuffled_order(id_column, seed), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def numbered(df: DataFrame, *order: str | Column, name: str = "row_no") -> DataFrame:
    """Adds the 0-based rank of each row in a total order.

    Rows are range-partitioned by the order and numbered within their range, which begins where the ranges before
    it end; only one count for each range is brought together.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = staged(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()).withColumns({f"_k{i}": k for i, k in enumerate(keys)}))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    names = [f"_k{i}" for i in range(len(keys))]
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*names))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + inside - 1).drop("_part", "_before", *names)


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows by ``order``; -1 takes all."""
    return df if n < 0 else df.orderBy(order).limit(n)


def sample_exact(df: DataFrame, n: int, id_column: str, seed: int = 0) -> DataFrame:
    """Exactly n rows: the whole table as often as it fits, plus a random remainder. Adds ``copy``, the number of the repetition."""
    total = df.count()
    if total == 0 or n <= 0:
        return df.where("false").withColumn("copy", F.lit(0))
    whole, rest = divmod(n, total)
    parts = []
    if whole:
        parts.append(df.select("*", F.explode(F.sequence(F.lit(0), F.lit(whole - 1))).alias("copy")))
    if rest:
        parts.append(df.orderBy(shuffled_order(id_column, seed), id_column).limit(rest).withColumn("copy", F.lit(whole)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def stratified(df: DataFrame, stratum: str, quotas: dict, id_column: str, seed: int = 0) -> DataFrame:
    """Up to a quota of random rows of each stratum.

    A threshold on the random number, set from counts with a wide margin, thins large strata in place; only the
    survivors are ranked, so that a stratum of a third of all rows is never ranked whole.
    """
    counts = {r[0]: r[1] for r in df.where(F.col(stratum).isin(list(quotas))).groupBy(stratum).count().collect()}  # one row a quota
    keep = F.lit(0.0)
    for value, quota in quotas.items():
        n = counts.get(value, 0)
        share = 1.0 if n <= 1000 or quota <= 0 else min(1.0, (quota + 6 * quota**0.5 + 20) / n)
        keep = F.when(F.col(stratum) == value, F.lit(share)).otherwise(keep)
    thinned = df.where((F.col(stratum).isin(list(quotas))) & (unit(id_column, seed) <= keep))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(shuffled_order(id_column, seed), id_column))
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col(stratum)]
    return thinned.withColumn("_rank", rank).where(F.col("_rank") <= quota).drop("_rank")


def ratio_quotas(ratios: dict, total: int) -> dict:
    """Whole quotas in proportion to ratios; what rounding leaves goes to the largest fractions (ties: first named)."""
    weight = sum(ratios.values())
    exact = {k: total * v / weight for k, v in ratios.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: out[k] - exact[k])[: total - sum(out.values())]:
        out[k] += 1
    return out


def split(df: DataFrame, share: float, id_column: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training rows and a validation share, by a threshold on the random number: no shuffle."""
    held = unit(id_column, seed) < share
    return df.where(~held), df.where(held)


def contiguous_piece(df: DataFrame, piece: int, pieces: int, order: str) -> DataFrame:
    """The piece-th of equal pieces by order; the remainder is dropped."""
    ranked = numbered(df, order)
    size = df.count() // pieces
    return ranked.where((F.col("row_no") >= piece * size) & (F.col("row_no") < (piece + 1) * size)).drop("row_no")


def strided_shard(df: DataFrame, shard: int, shards: int, order: str) -> DataFrame:
    """Every ``shards``-th row, beginning with the shard-th."""
    return numbered(df, order).where(F.pmod("row_no", F.lit(shards)) == shard).drop("row_no")


def balanced_shards(df: DataFrame, shards: int, order: str, name: str = "shard") -> DataFrame:
    """Adds the number of a balanced contiguous shard: the first ones have one row more where rows don't divide."""
    total = df.count()
    base, more = divmod(total, shards)
    edge, no = more * (base + 1), F.col("row_no")
    number = F.when(no < edge, F.floor(no / (base + 1))).otherwise(more + F.floor((no - edge) / max(base, 1)))
    return numbered(df, order).withColumn(name, number.cast("int")).drop("row_no")


def batches(df: DataFrame, batch_size: int, ranks: int, id_column: str, seed: int, drop_last: bool = True) -> DataFrame:
    """Adds ``step, rank, slot`` of a shuffled epoch: each step gives ``batch_size`` rows to each rank."""
    ranked = numbered(df, shuffled_order(id_column, seed), id_column)
    width = batch_size * ranks
    made = ranked.withColumns({
        "step": F.floor(F.col("row_no") / width), "rank": F.floor(F.pmod("row_no", F.lit(width)) / batch_size).cast("int"), "slot": F.pmod("row_no", F.lit(batch_size)).cast("int"),
    })
    full = df.count() // width
    return (made.where(F.col("step") < full) if drop_last else made).drop("row_no")


def interleave(sources: list[tuple[str, DataFrame, float]], id_column: str, seed: int, stop: str = "first_exhausted") -> DataFrame:
    """Rows of several sources in an order in which each source appears at its weight: ``source, id, place``.

    A row's place is its random rank in its source divided by the weight. With 'first_exhausted' the order ends
    where the first source does; with 'all_exhausted' all rows come out.
    """
    parts = []
    for name, df, weight in sources:
        if weight > 0:
            ranked = numbered(df.select(F.col(id_column).alias("id")), shuffled_order("id", seed), "id")
            parts.append(ranked.select(F.lit(name).alias("source"), "id", ((F.col("row_no") + 1) / F.lit(weight)).alias("place")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    if stop == "all_exhausted":
        return union
    union = staged(union)
    ends = union.groupBy("source").agg(F.max("place").alias("end")).agg(F.min("end").alias("end"))
    end = ends.first()["end"]
    return union if end is None else union.where(F.col("place") <= end)


def rotate_in_batches(df: DataFrame, column: str, order: str, batch: int) -> DataFrame:
    """Adds ``paired``: each row's value replaced by that of the row before it in its batch, the first by the last."""
    rows = numbered(df, order).withColumn("_b", F.floor(F.col("row_no") / batch))
    w = Window.partitionBy("_b").orderBy("row_no")
    last = F.last(column).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("paired", F.when(F.row_number().over(w) == 1, last).otherwise(F.lag(column).over(w))).drop("row_no", "_b")


def best_of_n(df: DataFrame, id_column: str, choices: str, orm: str, prm: str, keep: int = 1, prm_threshold: float = 0.0, orm_weight: float = 10.0, easy_share: float | None = None) -> DataFrame:
    """Preference rows ``id, chosen_pos, chosen, rejected, score`` from sampled answers with scores.

    Scores are normalised within a row (min-max); the mask (outcome score above 0 and process score above the
    threshold) applies before. The best ``keep`` by process + 10 x outcome are chosen as far as the mask allows; the
    worst is rejected. Rows without any unmasked answer give nothing, and with ``easy_share`` neither do rows of which
    that share is right. Missing scores of a row count as 1 for all its answers; answers without a score are left
    out. Equal scores: the later place ranks higher.
    """
    from tessera.functions.arrays import min_max
    n = F.size(choices)
    ones = F.array_repeat(F.lit(1.0), n)
    rows = df.where(F.col(choices).isNotNull()).select(F.col(id_column).alias("id"), F.col(choices).alias("c"), F.coalesce(orm, ones).alias("o"), F.coalesce(prm, ones).alias("p"), F.col(orm).isNotNull().alias("ho"), F.col(prm).isNotNull().alias("hp"))
    zipped = F.zip_with(F.arrays_zip("c", "o"), F.col("p"), lambda a, p: F.struct(a["c"].alias("c"), a["o"].alias("o"), p.alias("p")))
    rows = rows.select("id", "ho", "hp", F.filter(zipped, lambda z: z["c"].isNotNull() & z["o"].isNotNull() & z["p"].isNotNull()).alias("z")).where(F.size("z") > 0)
    rows = rows.select("id", "ho", "hp", "z", min_max(F.col("z.o")).alias("no"), min_max(F.col("z.p")).alias("np"))
    ranked = F.transform(
        "z",
        lambda z, i: F.struct(
            (F.get("np", i) + orm_weight * F.get("no", i)).alias("score"), i.alias("pos"), z["c"].alias("text"),
            ((~F.col("ho") | (z["o"] > 0)) & (~F.col("hp") | (z["p"] > prm_threshold))).alias("ok"), (F.get("no", i) > 0).alias("right"),
        ),
    )
    rows = rows.select("id", F.sort_array(ranked, asc=False).alias("r"))
    if easy_share is not None:
        rows = rows.where(F.size(F.filter("r", lambda x: x["right"])) - 1 < F.floor(F.size("r") * easy_share))
    chosen = F.filter(F.slice("r", 1, keep), lambda x: x["ok"])
    rejected = F.get("r", F.size("r") - 1)["text"]
    return rows.select("id", F.explode(chosen).alias("b"), rejected.alias("rejected")).select("id", F.col("b.pos").alias("chosen_pos"), F.col("b.text").alias("chosen"), "rejected", F.col("b.score").alias("score"))


def pending(requests: DataFrame, cache: DataFrame, id_column: str, wanted: int, choices: str = "choices") -> DataFrame:
    """Requests whose cached samples are missing or fewer than wanted."""
    done = cache.groupBy(id_column).agg(F.sum(F.size(choices)).alias("_n")).where(F.col("_n") >= wanted).select(id_column)
    return requests.join(done, id_column, "left_anti")


def weighted_choice(options: list[tuple[object, float]], id_column: str | Column, seed: int) -> Column:
    """One of several values for each row, at given weights, by the row's random number."""
    total = sum(w for _, w in options)
    x, out, upto = unit(id_column, seed), F.lit(options[-1][0]), 0.0
    edges = []
    for value, w in options:
        upto += w / total
        edges.append((value, upto))
    for value, edge in reversed(edges[:-1]):
        out = F.when(x < edge, F.lit(value)).otherwise(out)
    return out
