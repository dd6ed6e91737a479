"""Acceptance of draft tokens by step: means, chains, fixed depths, threshold sweeps and efficiency.

Inputs are long tables ``task, sample, step, accept, conf, ent``, a row for each step of a sample. A sweep joins
nothing: thresholds are an array on each sample's row (their number is a parameter), so its size is samples times
thresholds and it is aggregated in the same stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.arrays import IGNORED, linspace


def step_means(df: DataFrame) -> DataFrame:
    """Mean acceptance, confidence and entropy of each task and step; NaN and NULL values are left out."""
    value = lambda c: F.avg(F.when(~F.isnan(c), F.col(c)))
    return df.groupBy("task", "step").agg(F.avg("accept").alias("acc"), value("conf").alias("conf"), value("ent").alias("ent"), F.count(F.lit(1)).alias("n"))


def fixed_depth(df: DataFrame) -> DataFrame:
    """Mean acceptance over all steps up to each depth K: sums by step, accumulated over the few steps of a task."""
    sums = df.groupBy("task", "step").agg(F.sum("accept").alias("a"), F.count("accept").alias("n"))
    upto = Window.partitionBy("task").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return sums.select("task", F.col("step").alias("k"), (F.sum("a").over(upto) / F.sum("n").over(upto)).alias("acc"))


def chain_labels(df: DataFrame, *sample: str) -> DataFrame:
    """Adds ``label``: the step's acceptance while every earlier step was accepted, else ignored. Step 0 is always reached."""
    earlier = Window.partitionBy(*sample).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    alive = F.coalesce(F.min(F.coalesce("accept", F.lit(0))).over(earlier), F.lit(1)) == 1
    return df.withColumn("label", F.when(alive, F.col("accept")).otherwise(F.lit(IGNORED)))


def label_distribution(labelled: DataFrame, *keys: str) -> DataFrame:
    """Positive, negative and ignored labels, the positive rate among the counted ones, and the class weight neg / pos."""
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return labelled.groupBy(*keys).agg(
        pos.alias("pos"), neg.alias("neg"), F.count_if(F.col("label") == IGNORED).alias("ignored"), F.coalesce(F.try_divide(pos, pos + neg), F.lit(0.0)).alias("pos_rate"), F.try_divide(neg, pos).alias("pos_weight")
    )


def accepted_length(df: DataFrame, *sample: str) -> DataFrame:
    """``task, k, eal``: 1 + mean number of accepted steps before the first rejection, for each depth k of steps from 1 on."""
    steps = df.where("step >= 1")
    earlier = Window.partitionBy("task", *sample).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    alive = steps.select("task", *sample, "step", F.min(F.coalesce("accept", F.lit(0))).over(earlier).alias("alive"))
    by_step = alive.groupBy("task", "step").agg(F.sum("alive").alias("a"))
    samples = df.select("task", *sample).distinct().groupBy("task").agg(F.count(F.lit(1)).alias("samples"))
    upto = Window.partitionBy("task").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return by_step.join(samples, "task").select("task", F.col("step").alias("k"), (1 + F.sum("a").over(upto) / F.col("samples")).alias("eal"))


def by_sample(df: DataFrame, *sample: str) -> DataFrame:
    """One row a sample with ``steps``: its steps in order, as structs of step, accept, conf and ent."""
    return df.groupBy("task", *sample).agg(F.array_sort(F.collect_list(F.struct("step", "accept", "conf", "ent"))).alias("steps"))


def sweep(df: DataFrame, measure: str, stops_below: bool, *sample: str, thresholds: int = 40) -> DataFrame:
    """``task, thr, acc, mean_k``: stopping before the first step from 1 on whose ``measure`` is below (or above) a threshold.

    ``acc`` is the mean over samples of the mean acceptance of the steps used (step 0 always is). Thresholds are
    evenly spaced between the task's extremes. NULL and NaN never stop a sample and give no extremes.
    """
    value = F.when(~F.isnan(measure), F.col(measure))
    range_ = df.groupBy("task").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    rows = by_sample(df, *sample).join(F.broadcast(range_), "task")  # a row for each task
    # means up to each step are found once; a threshold then only chooses its step, and the steps aren't copied for it
    upto = lambda x: F.filter("steps", lambda s: (s["step"] <= x["step"]) & s["accept"].isNotNull())
    means = F.transform("steps", lambda x: F.struct(x["step"].alias("step"), F.try_divide(F.aggregate(upto(x), F.lit(0.0), lambda a, s: a + s["accept"]), F.size(upto(x))).alias("mean")))
    tests = F.transform(F.filter("steps", lambda s: s["step"] >= 1), lambda s: F.struct(s["step"].alias("step"), F.when(~F.isnan(s[measure]), s[measure]).alias("x")))
    rows = rows.select("task", linspace(F.col("low"), F.col("high"), thresholds).alias("thresholds"), means.alias("means"), tests.alias("tests"), F.array_max(F.transform("steps", lambda s: s["step"])).alias("deepest"))

    def chosen(thr: Column) -> Column:
        first = F.array_min(F.transform(F.filter("tests", lambda s: (s["x"] < thr) if stops_below else (s["x"] > thr)), lambda s: s["step"]))
        return F.struct(thr.alias("thr"), F.coalesce(first - 1, F.col("deepest")).alias("k"))

    each = rows.select("task", "means", F.posexplode(F.transform("thresholds", chosen)).alias("i", "c"))
    mean = F.element_at(F.filter("means", lambda m: m["step"] <= F.col("c.k")), -1)["mean"]
    return each.select("task", "i", "c.thr", "c.k", mean.alias("m")).groupBy("task", "i", "thr").agg(F.avg("m").alias("acc"), F.avg("k").alias("mean_k"))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The threshold with the best acceptance of each task, the first of equals; means that agree to nine digits are equal,
    since the order in which they were summed decides the rest."""
    return swept.groupBy("task").agg(F.max_by(F.struct("i", "thr", "acc", "mean_k"), F.struct(F.round("acc", 9), -F.col("i"))).alias("b")).select("task", "b.thr", "b.acc", "b.mean_k")


def efficiency(fixed: DataFrame, adaptive: DataFrame) -> DataFrame:
    """Gain of fixed depths and of an adaptive scheme by task.

    ``fixed``: ``task, k, eal`` of depths 0 to 3; ``adaptive``: ``task, i, eal, mean_k``. Gains are over 1; ``k90``
    is the first depth (mean depth) that reaches 90 % of the gain at depth 3; points below a mean depth of 0.1 don't
    count for efficiency.
    """
    f = fixed.groupBy("task").agg(F.coalesce(F.max(F.when(F.col("k") == 3, F.col("eal"))), F.lit(0.0)).alias("eal3"), F.collect_list(F.struct("k", "eal")).alias("points"))
    gain3 = F.col("eal3") - 1
    reaching = F.array_min(F.transform(F.filter("points", lambda p: p["eal"] - 1 >= 0.9 * gain3), lambda p: p["k"]))
    f = f.select("task", "eal3", F.when(gain3 > 0, gain3 / 3).otherwise(0.0).alias("gain_per_step"), F.coalesce(reaching, F.lit(3)).alias("k90_fixed"))
    a = adaptive.join(f.select("task", "eal3"), "task").groupBy("task").agg(
        F.max_by(F.struct("eal", "mean_k"), F.struct("eal", -F.col("i"))).alias("best"),
        F.min_by("mean_k", F.when(F.col("eal") - 1 >= 0.9 * (F.col("eal3") - 1), F.col("i"))).alias("k90"),
        F.max(F.when(F.col("mean_k") >= 0.1, (F.col("eal") - 1) / F.col("mean_k"))).alias("best_efficiency"),
    )
    return f.join(a, "task", "left").select(
        "task", "eal3", "gain_per_step", "k90_fixed", F.col("best.eal").alias("adaptive_eal"), F.col("best.mean_k").alias("adaptive_k"), (F.col("best.eal") - 1).alias("adaptive_gain"),
        ((F.col("best.eal") - 1) / F.greatest("best.mean_k", F.lit(0.01))).alias("gain_per_k"), F.col("k90").alias("adaptive_k90"), "best_efficiency",
    )


def request_totals(df: DataFrame, *keys: str) -> DataFrame:
    """Requests, tokens, and accept length: a ratio of sums, 1.0 for a group without any verify counter."""
    tokens, verified = F.sum("completion_tokens"), F.sum("spec_verify_ct")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"), tokens.alias("tokens"), verified.alias("verified"), F.coalesce(F.try_divide(F.sum(F.when(F.col("spec_verify_ct").isNotNull(), F.col("completion_tokens"))), verified), F.lit(1.0)).alias("accept_length")
    )
