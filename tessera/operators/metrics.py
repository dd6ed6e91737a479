"""Metrics: a registry of aggregate Column factories, and text metrics by Arrow functions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from math import exp, log

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.operators.series import running

METRICS: dict[str, Callable[..., dict[str, Column]]] = {}


def register_metric(name: str):
    """Register a function of columns that returns named aggregates."""

    def add(f):
        METRICS[name] = f
        return f

    return add


@register_metric("accuracy")
def accuracy(prediction: Column, label: Column) -> dict[str, Column]:
    return {"acc": F.avg(F.coalesce(prediction == label, F.lit(False)).cast("int"))}


def confusion(prediction: Column, label: Column) -> tuple[Column, Column, Column, Column]:
    """True and false positives, false and true negatives of 0/1 columns."""
    n = lambda p, y: F.count_if((prediction == p) & (label == y)).cast("double")
    return n(1, 1), n(1, 0), n(0, 1), n(0, 0)


@register_metric("acc_and_f1")
def acc_and_f1(prediction: Column, label: Column) -> dict[str, Column]:
    tp, fp, fn, tn = confusion(prediction, label)
    acc, f1 = F.try_divide(tp + tn, tp + fp + fn + tn), F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return {"acc": acc, "f1": f1, "acc_and_f1": (acc + f1) / 2}


@register_metric("mcc")
def matthews(prediction: Column, label: Column) -> dict[str, Column]:
    """Matthews' correlation; 0 where a margin is empty."""
    tp, fp, fn, tn = confusion(prediction, label)
    return {"mcc": F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0))}


@register_metric("mean")
def mean(value: Column) -> dict[str, Column]:
    """Mean of what is neither NULL nor NaN; NaN if nothing is left."""
    return {"mean": F.coalesce(F.avg(F.when(~F.isnan(value), value)), F.lit(float("nan")))}


@register_metric("array_stats")
def array_stats(value: Column) -> dict[str, Column]:
    return {"mean": F.avg(value), "std": F.stddev_pop(value), "min": F.min(value), "max": F.max(value), "size": F.count(value)}


@register_metric("weighted_loss")
def weighted_loss(loss: Column, weight: Column) -> dict[str, Column]:
    return {"loss": F.try_divide(F.sum(loss * weight), F.sum(weight))}


@register_metric("preference_balance")
def preference_balance(desirable: Column) -> dict[str, Column]:
    """Desirable and undesirable rows, and between which weights of the former the two are balanced 1 to 1 up to 4 to 3."""
    good, bad = F.count_if(desirable), F.count_if(~desirable)
    good1, bad1 = F.greatest(good, F.lit(1)), F.greatest(bad, F.lit(1))
    return {"desirable": good, "undesirable": bad, "low": F.round(bad1 / good1, 2), "high": F.round(bad1 * 1.33 / good1, 2)}


def evaluate(df: DataFrame, metric: str, *columns: Column, by: list[str] | None = None) -> DataFrame:
    """One row (or one for each group) with the metric's values."""
    made = [c.alias(n) for n, c in METRICS[metric](*columns).items()]
    return df.groupBy(*by).agg(*made) if by else df.agg(*made)


def correlations(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Pearson's and Spearman's correlation and their mean, by key; ranks of equal values are averaged.

    Ranks come from running sums over the counts of distinct values, range by range: no group is sorted in one task.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_key", F.struct(*keys) if keys else F.lit(0))
    for c, r in ((x, "_rx"), (y, "_ry")):
        counts = running(rows.groupBy("_key", c).agg(F.count(F.lit(1)).alias("_n")), "_key", c, "_n", "sum", before=True, name="_before")
        rows = rows.join(counts.select("_key", c, (F.col("_before") + (F.col("_n") + 1) / 2).alias(r)), ["_key", c])
    return rows.groupBy(*keys).agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman")).withColumn("mean", (F.col("pearson") + F.col("spearman")) / 2)


# Scripts without blanks between words; each of their characters is a word.
_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af]|[^\s\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af]+")


def words_of(text: str) -> list[str]:
    """Words between blanks; of Chinese and Japanese text every character."""
    return _WORD.findall(text)


def _ngrams(words: list[str], n: int) -> Counter:
    return Counter(zip(*(words[i:] for i in range(n))))


def rouge_n(said: list[str], wanted: list[str], n: int) -> float:
    a, b = _ngrams(said, n), _ngrams(wanted, n)
    common = sum((a & b).values())
    if not common:
        return 0.0
    p, r = common / sum(a.values()), common / sum(b.values())
    return 2 * p * r / (p + r)


def common_length(said: list[str], wanted: list[str]) -> int:
    """Length of the longest common subsequence, all columns of the table at once as bits of a number."""
    masks: dict[str, int] = {}
    for j, y in enumerate(wanted):
        masks[y] = masks.get(y, 0) | 1 << j
    every = (1 << len(wanted)) - 1
    row = every
    for x in said:
        hit = row & masks.get(x, 0)
        row = (row + hit) | (row - hit)
    return len(wanted) - (row & every).bit_count()


def rouge_l(said: list[str], wanted: list[str]) -> float:
    common = common_length(said, wanted) if said and wanted else 0
    if not common:
        return 0.0
    p, r = common / len(said), common / len(wanted)
    return 2 * p * r / (p + r)


def bleu_4(said: str, wanted: str) -> float:
    """Character BLEU-4; an order without a match counts as half of the one before (geometric smoothing)."""
    if not said or not wanted:
        return 0.0
    total, halves = 0.0, 1
    for n in range(1, 5):
        a, b = _ngrams(list(said), n), _ngrams(list(wanted), n)
        possible = max(1, sum(a.values()))
        hits = sum((a & b).values())
        if not hits:
            if n == 1:
                return 0.0
            halves *= 2
            total += log(1 / (halves * possible)) / 4
        else:
            total += log(hits / possible) / 4
    return exp(min(0.0, 1 - len(wanted) / len(said)) + total)


@F.pandas_udf(StructType([StructField(m, DoubleType()) for m in ("rouge_1", "rouge_2", "rouge_l", "bleu_4")]))
def text_scores(said: pd.Series, wanted: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(said, wanted):
        if not a or not b or not a.strip() or not b.strip():
            rows.append((None,) * 4)
            continue
        x, y = words_of(a), words_of(b)
        rows.append((rouge_n(x, y, 1), rouge_n(x, y, 2), rouge_l(x, y), bleu_4(a, b)))
    return pd.DataFrame(rows, columns=["rouge_1", "rouge_2", "rouge_l", "bleu_4"], dtype="float64")


def generation_quality(df: DataFrame, said: str, wanted: str) -> DataFrame:
    """Mean ROUGE-1, 2, L and BLEU-4, times 100, over pairs of which neither is empty; words as in ``words_of``."""
    scored = df.select(text_scores(F.col(said), F.col(wanted)).alias("s"))
    return scored.agg(*[F.round(F.avg(f"s.{m}") * 100, 6).alias(m) for m in ("rouge_1", "rouge_2", "rouge_l", "bleu_4")])


def unigram_overlap(df: DataFrame, id_column: str, said: Column, wanted: Column) -> DataFrame:
    """``id, rouge_1`` by joins and aggregations alone: multiset intersection of words."""
    a = df.select(F.col(id_column).alias("id"), F.explode(said).alias("w")).groupBy("id", "w").agg(F.count(F.lit(1)).alias("a"))
    b = df.select(F.col(id_column).alias("id"), F.explode(wanted).alias("w")).groupBy("id", "w").agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, ["id", "w"], "full").groupBy("id").agg(
        F.sum(F.least(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)))).alias("common"), F.sum(F.coalesce("a", F.lit(0))).alias("na"), F.sum(F.coalesce("b", F.lit(0))).alias("nb")
    )
    return both.select("id", F.coalesce(F.try_divide(2 * F.col("common"), F.col("na") + F.col("nb")), F.lit(0.0)).alias("rouge_1"))
