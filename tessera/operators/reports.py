"""Roll-ups, comparisons of runs, lookups with fallback, trees and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.runtime import staged


def error_rollup(df: DataFrame, error: str, example: str, examples: int = 3) -> DataFrame:
    """``error, n, examples``: how often each error occurs, with the least of its examples (the number is the feature)."""
    ranked = df.groupBy(error, example).agg(F.count(F.lit(1)).alias("_n"))
    top = F.row_number().over(Window.partitionBy(error).orderBy(example))
    kept = ranked.withColumn("_r", top).where(F.col("_r") <= examples).groupBy(error).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    counts = ranked.groupBy(error).agg(F.sum("_n").alias("n"))
    return counts.join(kept, counts[error].eqNullSafe(kept[error]), "left").select(counts[error], "n", "examples")


def nested_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """``outer, n, kinds, major, major_n``: by outer key the total, number of inner keys, and the commonest (ties: the least)."""
    counts = df.groupBy(outer, inner).agg(F.count(F.lit(1)).alias("_n"))
    least = F.min_by(F.struct(F.col(inner).alias("k"), F.col("_n").alias("n")), F.struct(-F.col("_n"), F.col(inner)))
    return counts.groupBy(outer).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("kinds"), least.alias("m")).select(outer, "n", "kinds", F.col("m.k").alias("major"), F.col("m.n").alias("major_n"))


def pivot_first(df: DataFrame, row: str, column: str, value: str, order: str, columns: list) -> DataFrame:
    """One row for each ``row`` and a column for each of ``columns`` with the first value by ``order``."""
    return df.groupBy(row).agg(*[F.min_by(value, F.when(F.col(column) == c, F.col(order))).alias(str(c)) for c in columns])


def run_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key, change`` of keys in one run only: 'removed' or 'added'."""
    a, b = (d.select(key).distinct() for d in (before, after))
    return a.join(b, key, "left_anti").withColumn("change", F.lit("removed")).unionByName(b.join(a, key, "left_anti").withColumn("change", F.lit("added")))


def joined_runs(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer join of two runs on a key."""
    return before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full")


def skip_report(df: DataFrame, test: str, model: str, skipped: Column, reason: Column) -> DataFrame:
    """``test, ran, skipped, share, reasons``: models that ran and skipped a test, share of skips (4 digits), distinct reasons."""
    flagged = df.select(test, model, skipped.alias("_s"), F.when(skipped, reason).alias("_r"))
    n, total = F.count_if("_s"), F.count(F.lit(1))
    return flagged.groupBy(test).agg(
        F.array_sort(F.collect_set(F.when(~F.col("_s"), F.col(model)))).alias("ran"), F.array_sort(F.collect_set(F.when(F.col("_s"), F.col(model)))).alias("skipped"),
        F.round(n / total, 4).alias("share"), F.array_sort(F.collect_set("_r")).alias("reasons"),
    )


def complete_grid(df: DataFrame, rows: DataFrame, row: str, column: str, columns: list, value: str, default) -> DataFrame:
    """Every row with every one of ``columns`` (a given list), missing values replaced by a default."""
    grid = rows.select(row).distinct().select(row, F.explode(F.array(*[F.lit(c) for c in columns])).alias(column))
    return grid.join(df.select(row, column, value), [row, column], "left").withColumn(value, F.coalesce(value, F.lit(default)))


def prefix_lookup(df: DataFrame, name: str, registry: DataFrame, key: str, value: str, separator: str = "_") -> DataFrame:
    """Adds ``value`` of the longest prefix of ``name`` (whole words) that the registry holds; NULL if it holds none.

    Every prefix is one row of an equi-join; the longest hit wins. No loop over the registry.
    """
    distinct = df.select(name).where(F.col(name).isNotNull()).distinct()
    parts = F.split(name, separator)
    prefixes = distinct.select(name, F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))).alias("_len", "_prefix"))
    hits = prefixes.join(registry.select(F.col(key).alias("_prefix"), F.col(value).alias(value)), "_prefix").groupBy(name).agg(F.max_by(value, "_len").alias(value))
    return df.join(hits, name, "left")


def first_lookup(df: DataFrame, key: str, tables: list[tuple[DataFrame, str, str]], default) -> Column | DataFrame:
    """Adds ``found`` from the first of several lookup tables that holds the key, else the default. Of several values of a
    key in one table the least counts."""
    out, columns = df, []
    for i, (dim, k, v) in enumerate(tables):
        out = out.join(dim.groupBy(F.col(k).alias(f"_k{i}")).agg(F.min(v).alias(f"_v{i}")), F.col(key) == F.col(f"_k{i}"), "left")
        columns.append(F.col(f"_v{i}"))
    return out.withColumn("found", F.coalesce(*columns, F.lit(default))).drop(*[f"_{x}{i}" for i in range(len(tables)) for x in "kv"])


def tree_paths(nodes: DataFrame, tree: str, node: str, parent: str, outcome: str, process: str) -> DataFrame:
    """``tree, node, depth, mean_outcome, min_outcome, mean_process, min_process`` over the path from the root, for every node.

    Level by level: one join a level, until no node has children. A root has a NULL parent. Parents that form a cycle
    below a root, which only a node of several parents can, raise ValueError.
    """
    base = nodes.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(outcome).cast("double").alias("o"), F.col(process).cast("double").alias("p"))
    level = base.where("parent IS NULL").select("tree", "node", F.lit(1).alias("depth"), F.col("o").alias("so"), F.col("o").alias("mo"), F.col("p").alias("sp"), F.col("p").alias("mp"))
    levels = []
    while (level := staged(level)).head(1):
        levels.append(level)
        if len(levels) % 64 == 0 and len(levels) > base.count():  # no path is longer than there are nodes
            raise ValueError("the parents form a cycle")
        up = level.withColumnRenamed("node", "parent")
        level = base.join(up, ["tree", "parent"]).select(
            "tree", "node", (F.col("depth") + 1).alias("depth"), (F.col("so") + F.col("o")).alias("so"), F.least("mo", "o").alias("mo"), (F.col("sp") + F.col("p")).alias("sp"), F.least("mp", "p").alias("mp")
        )
    if not levels:
        levels = [level]
    union = levels[0]
    for x in levels[1:]:
        union = union.unionByName(x)
    return union.select("tree", "node", "depth", (F.col("so") / F.col("depth")).alias("mean_outcome"), F.col("mo").alias("min_outcome"), (F.col("sp") / F.col("depth")).alias("mean_process"), F.col("mp").alias("min_process"))


def preference_pairs(nodes: DataFrame, tree: str, node: str, parent: str, outcome: str, gap: float) -> DataFrame:
    """``tree, parent, good, good_score, bad, bad_score``: best and worst child of each node whose outcomes differ by more than a gap."""
    by = lambda f, s: f(F.struct(F.col(node).alias("n"), F.col(outcome).alias("o")), F.struct(F.col(outcome), s * F.col(node)))
    pairs = nodes.where(F.col(parent).isNotNull()).groupBy(tree, parent).agg(by(F.max_by, 1).alias("g"), by(F.min_by, 1).alias("b"))
    return pairs.where(F.col("g.o") - F.col("b.o") > gap).select(tree, parent, F.col("g.n").alias("good"), F.col("g.o").alias("good_score"), F.col("b.n").alias("bad"), F.col("b.o").alias("bad_score"))


def markdown(df: DataFrame, columns: list[str], order: str, rows: int) -> DataFrame:
    """One row with a Markdown table of the first rows by descending order (the number is the feature)."""
    top = df.orderBy(F.desc(order), *columns).limit(rows)
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "-|" * len(columns)
    lines = top.select(F.struct((-F.col(order)).alias("o"), *columns, line.alias("line")).alias("l")).agg(F.array_sort(F.collect_list("l")).alias("ls"))
    return lines.select(F.concat_ws("\n", F.lit(head), F.transform("ls", lambda x: x["line"])).alias("report"))


def half_even_minutes(start: Column, end: Column) -> Column:
    """Minutes between two timestamps, rounded half to even."""
    return F.bround((F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))) / F.lit(60.0)).cast("long")


def duration_seconds(text: Column) -> Column:
    """Seconds of ``h:m:s``, ``m:s`` or ``s``; NULL if a part is no number."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p)


def duration_text(seconds: Column) -> Column:
    s = seconds.cast("long")
    return F.format_string("%dh%dm%ds", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def normalised_log_line(line: Column) -> Column:
    """A test summary line without counts and messages: status and place, or what stands before `` - ``."""
    status = F.regexp_extract(line, r"^(SKIPPED|XFAIL|XPASS|EXPECTEDFAIL)\s+\[?\d*\]?\s*(\S+:\d+)", 1)
    place = F.regexp_extract(line, r"^(SKIPPED|XFAIL|XPASS|EXPECTEDFAIL)\s+\[?\d*\]?\s*(\S+:\d+)", 2)
    return F.when(status != "", F.concat_ws(" ", status, place)).when(line.rlike("^(ERROR|FAILED)"), F.btrim(F.regexp_replace(line, r"(?s)\s+-\s+.*", ""))).otherwise(line)
