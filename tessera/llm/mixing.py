"""Problem 7: mixing sources to target weights.

Method: subset-sum budget fitting. Documents are counted by source and exact token length. The total is the largest
at which no source with documents must be repeated more than its plan allows; a source's budget is its share of it.
A budget is met by whole rounds through the source, and by a choice of documents for the rest: lengths are taken in
seeded order until little is left, and a bounded knapsack over the lengths not taken (dynamic programming, every
length with its count) fits what remains to the token, or as near as the lengths allow. How many documents of each
length get one more use is then handed back to the documents: the first so many of each length in seeded order.

Only counts by length are ever brought together (one row for each length of a source, whatever the number of
documents). Lengths that very many documents share are dealt into buckets by the seeded order first, so that no
task ranks many more than BUCKET_ROWS documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.llm.packing import sized_documents
from tessera.runtime import hot_bound, staged, table

#: Sources of all plans together, at most: they are few rows of a small table, which may be broadcast.
MAX_PLAN_ROWS = 100_000
#: Tokens of a budget that are left to the knapsack; it never fits more than four times as many.
KNAPSACK_TOKENS = 60_000
BUCKET_ROWS = 200_000
SEED = 11


def source_name(column: Column) -> Column:
    """A source's name without letter case, outer blanks and hyphens for underscores."""
    return F.lower(F.translate(F.trim(F.regexp_replace(column, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), "-", "_"))


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length add up to the largest total within ``budget`` (bounded subset sum, exact)."""
    take = np.zeros(len(lengths), dtype=np.int64)
    if budget <= 0 or not len(lengths):
        return take
    # reached[s]: index of the item whose use first reached s, or -1; binary splitting of the counts
    reached = np.full(budget + 1, -1, dtype=np.int64)
    open_ = np.zeros(budget + 1, dtype=bool)
    open_[0] = True
    items: list[tuple[int, int]] = []
    for k in np.argsort(-lengths, kind="stable").tolist():
        left, bundle = int(min(counts[k], budget // lengths[k])), 1
        while left > 0:
            n = min(bundle, left)
            size = int(lengths[k]) * n
            fresh = np.zeros(budget + 1, dtype=bool)
            fresh[size:] = open_[:-size] if size else open_
            fresh &= ~open_
            if fresh.any():
                reached[fresh] = len(items)
                open_ |= fresh
            items.append((k, n))
            left -= n
            bundle *= 2
        if open_[budget]:
            break
    s = int(np.flatnonzero(open_)[-1])
    while s:
        k, n = items[reached[s]]
        take[k] += n
        s -= int(lengths[k]) * n
    return take


def choose(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: str) -> np.ndarray:
    """How many documents of each length to take so that their tokens come as near to ``budget`` as possible.

    All but the last KNAPSACK_TOKENS are taken in equal proportion of every length, so that the choice is like the
    source; the rest is fitted exactly.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.zeros(len(lengths), dtype=np.int64)
    if budget > KNAPSACK_TOKENS:
        take = (counts * ((budget - KNAPSACK_TOKENS // 2) / total)).astype(np.int64)
        room = budget - KNAPSACK_TOKENS // 2 - int((lengths * take).sum())
        # what rounding left out, a document of a length at a time in seeded order
        digest = np.array([int.from_bytes(hashlib.md5(f"{seed}:{n}".encode()).digest()[:7], "big") for n in lengths.tolist()])
        for i in np.argsort(digest, kind="stable").tolist():
            if take[i] < counts[i] and lengths[i] <= room:
                take[i] += 1
                room -= int(lengths[i])
        while (rest := budget - int((lengths * take).sum())) > 4 * KNAPSACK_TOKENS:
            spare = np.flatnonzero((take < counts) & (lengths <= rest))
            if not len(spare):
                break
            i = spare[np.argmax(lengths[spare] * (counts - take)[spare])]
            take[i] += min(int(counts[i] - take[i]), max(1, (rest - KNAPSACK_TOKENS) // int(lengths[i])))
    rest = budget - int((lengths * take).sum())
    fitted = take + knapsack(lengths, counts - take, min(rest, 4 * KNAPSACK_TOKENS))
    # one document more may come nearer from above
    below = budget - int((lengths * fitted).sum())
    spare = np.flatnonzero(fitted < counts)
    if below > 0 and len(spare):
        i = spare[np.argmin(lengths[spare])]
        if int(lengths[i]) - below < below:
            fitted[i] += 1
    return fitted


def _plan_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source of one plan: whole rounds through all documents, and one more use for some of each length."""
    budget, repeats = int(pdf["budget"].iloc[0]), int(pdf["max_repeats"].iloc[0])
    pdf = pdf.sort_values("tokens").reset_index(drop=True)
    lengths, counts = pdf["tokens"].to_numpy(dtype=np.int64), pdf["n"].to_numpy(dtype=np.int64)
    total = int((lengths * counts).sum())
    rounds = min(repeats, budget // total)
    more = np.zeros(len(lengths), dtype=np.int64)
    if rounds < repeats:
        more = choose(lengths, counts, budget - rounds * total, f"{SEED}:{pdf['plan_id'].iloc[0]}:{pdf['name'].iloc[0]}")
    return pdf[["plan_id", "name", "tokens", "n"]].assign(rounds=rounds, more=more)


def mix(documents: DataFrame, plans: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``plan_id, source, doc, tokens, uses, target_share, actual_share``: the uses of every document of a plan's sources.

    ``documents``: id, ``source``, ``tokens``; ``plans``: ``plan_id, source, target_weight, max_repeats``. Names are
    compared without case, outer blanks and hyphens. Shares are in proportion to the weights, of which NULL or
    negative ones count as 0; a source that a plan names twice has the sum of the weights and the larger
    ``max_repeats`` (NULL or below 0: 0). The total is the largest at which all sources with documents reach their
    targets; a source without documents, or with 0 repeats, can't contribute and comes out as one row without a
    document. Documents whose id, source or size is NULL, or whose source no plan names, are never used; repeated
    rows are documents of their own. A tie between documents of one length is decided by a seeded hash, then by id.
    """
    name = source_name(F.col("source"))
    plan = plans.where("plan_id IS NOT NULL AND source IS NOT NULL").groupBy(F.col("plan_id").cast("int").alias("plan_id"), name.alias("name")).agg(
        F.sum(F.greatest(F.coalesce(F.nanvl("target_weight", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))).alias("weight"), F.greatest(F.max(F.coalesce("max_repeats", F.lit(0))), F.lit(0)).alias("max_repeats")
    )
    whole = F.sum("weight").over(Window.partitionBy("plan_id"))
    plan = plan.withColumn("target_share", F.coalesce(F.try_divide(F.col("weight"), whole), F.lit(0.0)))
    docs = documents.select(F.col(id_column).cast("long").alias("doc"), name.alias("name"), F.col("tokens").cast("long").alias("tokens")).where("doc IS NOT NULL AND name IS NOT NULL AND tokens >= 1")
    docs = docs.withColumn("order", F.xxhash64("doc", F.lit(SEED)))
    lengths = staged(docs.groupBy("name", "tokens").agg(F.count(F.lit(1)).alias("n")))  # one row a length
    held = lengths.groupBy("name").agg(F.sum(F.col("tokens") * F.col("n")).alias("held"))
    plan = staged(plan.join(held, "name", "left"))
    pairs = plan.count()
    if pairs > MAX_PLAN_ROWS:
        raise ValueError(f"{pairs} sources of plans; at most {MAX_PLAN_ROWS} are taken at once")
    usable = F.coalesce("held", F.lit(0)) * F.col("max_repeats")
    # the total: no source may need more than it has; those that have nothing don't bind
    limit = F.min(F.when((F.col("target_share") > 0) & (usable > 0), usable / F.col("target_share"))).over(Window.partitionBy("plan_id"))
    budgets = plan.withColumn("budget", F.when(usable > 0, F.floor(F.coalesce(limit * F.col("target_share"), F.lit(0.0)) + 1e-6)).otherwise(0).cast("long"))
    budgets = staged(budgets.withColumn("budget", F.least("budget", usable.cast("long"))))
    wanted = F.broadcast(budgets.where("budget > 0")).join(lengths, "name")
    # a number of partitions of its own: by their few bytes all sources would go to one task
    wanted = wanted.repartition(max(1, min(4 * documents.sparkSession.sparkContext.defaultParallelism, pairs)), "plan_id", "name")
    chosen = staged(wanted.groupBy("plan_id", "name").applyInPandas(_plan_source, "plan_id int, name string, tokens long, n long, rounds long, more long"))
    shares = chosen.groupBy("plan_id", "name").agg(F.sum(F.col("tokens") * (F.col("rounds") * F.col("n") + F.col("more"))).alias("used"))
    shares = budgets.select("plan_id", "name", "target_share").join(shares, ["plan_id", "name"], "left").withColumn("used", F.coalesce("used", F.lit(0)))
    shares = shares.withColumn("actual_share", F.coalesce(F.try_divide(F.col("used"), F.sum("used").over(Window.partitionBy("plan_id"))), F.lit(0.0)))
    # back to documents. A length of very many documents is dealt into buckets of the seeded order; only such lengths are broadcast.
    bound = hot_bound(lengths, "n", BUCKET_ROWS)
    buckets = F.when(F.col("n") >= bound, F.ceil(F.col("n") / bound)).otherwise(1).cast("int")
    crowded = F.broadcast(lengths.where(F.col("n") >= bound).select("name", "tokens", buckets.alias("buckets")))
    dealt = docs.join(F.broadcast(budgets.select("name").distinct()), "name").join(crowded, ["name", "tokens"], "left")
    dealt = dealt.select("name", "tokens", "doc", "order", F.coalesce(F.pmod("order", F.col("buckets")), F.lit(0)).cast("int").alias("bucket"), (F.col("buckets") > 1).alias("many"))
    sizes = dealt.where("many").groupBy("name", "tokens", "bucket").agg(F.count(F.lit(1)).alias("m"))
    earlier = Window.partitionBy("name", "tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("name", "tokens", "bucket", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))
    # how many of a bucket get one more use, for every plan at once
    more = chosen.join(lengths.select("name", "tokens", F.sequence(F.lit(0), buckets - 1).alias("b")), ["name", "tokens"]).select("name", "tokens", F.explode("b").alias("bucket"), "plan_id", "rounds", "more")
    more = more.join(sizes, ["name", "tokens", "bucket"], "left").groupBy("name", "tokens", "bucket").agg(F.first(F.coalesce("before", F.lit(0))).alias("before"), F.collect_list(F.struct("plan_id", "rounds", "more")).alias("plans"))
    rank = F.row_number().over(Window.partitionBy("name", "tokens", "bucket").orderBy("order", "doc"))
    ranked = dealt.select("name", "tokens", "bucket", "doc", rank.alias("rank")).join(more, ["name", "tokens", "bucket"], "left")
    used = F.transform("plans", lambda p: F.struct(p["plan_id"].alias("plan_id"), (p["rounds"] + (F.col("rank") + F.col("before") <= p["more"]).cast("long")).alias("uses")))
    ranked = ranked.select("name", "tokens", "doc", F.map_from_entries(F.coalesce(used, F.array().cast("array<struct<plan_id:int,uses:bigint>>"))).alias("used"))
    uses = ranked.join(F.broadcast(budgets.select("plan_id", "name")), "name").select("plan_id", "name", "doc", "tokens", F.coalesce(F.try_element_at("used", "plan_id"), F.lit(0)).alias("uses"))
    held_rows = uses.join(F.broadcast(shares), ["plan_id", "name"])
    empty = shares.join(F.broadcast(budgets.where("held IS NULL").select("plan_id", "name")), ["plan_id", "name"]).select("plan_id", "name", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("tokens"), F.lit(0).cast("long").alias("uses"), "target_share", "actual_share")
    return held_rows.select("plan_id", "name", "doc", "tokens", "uses", "target_share", "actual_share").unionByName(empty).select(
        "plan_id", F.col("name").alias("source"), "doc", "tokens", F.coalesce("uses", F.lit(0)).alias("uses"), "target_share", "actual_share"
    )


def p7_mixed(spark: SparkSession, root: str) -> DataFrame:
    """How often each document is used in each plan, beside the target and actual share of its source."""
    return mix(sized_documents(table(spark, root, "documents")), table(spark, root, "mix_plans")).withColumnRenamed("doc", "doc_id")


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and actual share of each source of each plan, with its tokens and the most uses of one of its documents."""
    return p7_mixed(spark, root).groupBy("plan_id", "source", "target_share", "actual_share").agg(F.coalesce(F.sum(F.col("uses") * F.col("tokens")), F.lit(0)).alias("used_tokens"), F.max("uses").alias("most_uses"))


def p7_checked(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of ``p7_mixed``: for every source of a plan its target share, its documents, uses above the limit,
    and whether its share of the tokens misses the target (among the sources that have documents) by over 0.1 % and by more
    tokens than its longest document has: whole documents of a small source can't come nearer in every case."""
    plans = table(spark, root, "mix_plans").groupBy("plan_id", source_name(F.col("source")).alias("source")).agg(F.max("max_repeats").alias("most"))
    mixed = p7_mixed(spark, root).join(F.broadcast(plans), ["plan_id", "source"])  # a row for each source of a plan
    each = mixed.groupBy("plan_id", "source", "target_share", "actual_share").agg(F.count("doc_id").alias("documents"), F.count_if(F.col("uses") > F.col("most")).alias("over_limit"), F.sum(F.col("uses") * F.col("tokens")).alias("used"), F.max("tokens").alias("longest"))
    plan = Window.partitionBy("plan_id")  # the sources of one plan
    reachable = F.sum(F.when((F.col("documents") > 0) & (F.col("used") > 0), F.col("target_share"))).over(plan)
    stated = F.abs(F.col("actual_share") - F.coalesce(F.col("used"), F.lit(0)) / F.sum("used").over(plan)) > 1e-9
    miss = F.abs(F.col("actual_share") - F.col("target_share") / reachable)
    missed = (F.col("documents") > 0) & (miss > 1e-3) & (miss * F.sum("used").over(plan) > F.col("longest"))
    return each.select("plan_id", "source", F.round("target_share", 9).alias("target_share"), "documents", "over_limit", (stated | missed).cast("long").alias("off_target"))


SQL = {
    "p7_checked": r"""
WITH d AS (SELECT replace(lower(regexp_replace(regexp_replace(source, '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '')), '-', '_') AS source FROM documents
  WHERE regexp_matches(text, '[^\s\p{Z}\x{85}\x0b]') AND source IS NOT NULL AND coalesce(n_tokens, 1) >= 1),
n AS (SELECT source, count(*) AS n FROM d GROUP BY source),
p AS (SELECT plan_id, replace(lower(trim(source)), '-', '_') AS source, sum(target_weight) AS w FROM mix_plans GROUP BY ALL)
SELECT plan_id, source, round(w / sum(w) OVER (PARTITION BY plan_id), 9) AS target_share, coalesce(n, 0) AS documents, 0 AS over_limit, 0 AS off_target FROM p LEFT JOIN n USING (source)""",
}
