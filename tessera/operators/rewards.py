"""Rule-based rewards: a registry of Column factories over a completion (and a reference)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from tessera.functions import parsing as S, text as T
from tessera.functions.text import let

REWARDS: dict[str, Callable[..., Column]] = {}


def register_reward(name: str):
    def add(f):
        if name in REWARDS:
            raise ValueError(f"reward {name} is registered already")
        REWARDS[name] = f
        return f

    return add


register_reward("format")(S.think_answer_format)
register_reward("react_format")(S.think_action_format)


@register_reward("accuracy")
def accuracy(completion: Column, solution: Column) -> Column:
    """1.0 for an equal final answer (numerically or as normalised text), else 0.0."""
    return F.coalesce(S.same_answer(completion, solution), F.lit(False)).cast("double")


@register_reward("repetition")
def repetition(completion: Column, n: int = 3, worst: float = -1.0) -> Column:
    """Share of repeated n-grams of lower-case words, times the worst reward; 0 for fewer than n words."""
    return let(T.word_ngrams(F.lower(completion), n), lambda g: F.when(F.size(g) > 0, (1 - F.size(F.array_distinct(g)) / F.size(g)) * worst).otherwise(0.0))


@register_reward("cosine")
def cosine(length: Column, is_correct: Column, max_length: int = 1000, wrong: tuple[float, float] = (-0.5, 0.0), correct: tuple[float, float] = (1.0, 0.5)) -> Column:
    """A reward between two values by a half cosine over the length; ``wrong`` and ``correct``: at length 0 and at the maximum."""
    def half(at_zero: float, at_end: float) -> Column:
        # for wrong answers the curve runs from the first value to the second, for right ones likewise
        return F.lit(at_zero) - F.lit(at_zero - at_end) * (1 - F.cos(length * math.pi / max_length)) / 2

    return F.when(is_correct, half(*correct)).otherwise(half(*wrong))


@register_reward("soft_overlong")
def soft_overlong(length: Column, soft_max: int, soft_cache: int) -> Column:
    """0 up to soft_max - soft_cache, then falling linearly."""
    if soft_cache >= soft_max:
        raise ValueError("the cache must be shorter than the maximum")
    return F.least(-(length - (soft_max - soft_cache)) / F.lit(float(soft_cache)), F.lit(0.0))


@register_reward("math")
def math_answer(completion: Column, solution: Column) -> Column:
    """1.0 if the final answers (in a box, after ``# Answer``) are equal as mathematics, see ``parsing.equal_mathematics``, else 0.0."""
    said, wanted = (S.boxed_whole(S.after(x, "# Answer")) for x in (completion, solution))
    return F.coalesce(S.equal_mathematics(said, wanted), F.lit(False)).cast("double")


def action_f1(completion: Column, reference: Column) -> Column:
    """F-measure of the last action's input against the reference's, over the keys of two JSON objects.

    A key with the same value counts 1, with another value a half. 0 if the actions differ or an input is no JSON
    object; 1 for two empty objects.
    """
    a, b = S.action_of(completion), S.action_of(reference)
    x, y = (F.from_json(s["input"], "map<string,string>", {"mode": "PERMISSIVE"}) for s in (a, b))
    hits = F.aggregate(F.map_entries(y), F.lit(0.0), lambda n, e: n + F.when(~F.map_contains_key(x, e["key"]), 0.0).when(F.element_at(x, e["key"]).eqNullSafe(e["value"]), 1.0).otherwise(0.5))
    both = F.size(x) + F.size(y)
    f1 = F.when(both == 0, 1.0).otherwise(F.try_divide(2 * hits, both))
    return F.when((a["action"] == b["action"]) & x.isNotNull() & y.isNotNull(), F.coalesce(f1, F.lit(0.0))).otherwise(0.0)


@register_reward("toolbench")
def toolbench(completion: Column, reference: Column) -> Column:
    """1.0 if the last action and its input are wholly the reference's (an F-measure of 1), else 0.0."""
    return (action_f1(completion, reference) == 1.0).cast("double")


def least_process_reward(scores: Column) -> Column:
    """A process reward of several steps counts by its worst step; NULL or empty: 0."""
    return F.coalesce(F.array_min(scores), F.lit(0.0))


def mean_extracted(texts: Column) -> Column:
    """Mean of the rewards that texts state; 0 if none does."""
    values = F.filter(F.transform(texts, S.reward_value), lambda v: v.isNotNull())
    return F.coalesce(F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values)), F.lit(0.0))


# ---- registries of process rewards and of reward models: how a column of scores or of a judge's texts is read -----
PROCESS_REWARDS: dict[str, Callable[..., Column]] = {}
REWARD_MODELS: dict[str, Callable[..., Column]] = {}


def _registering(registry: dict, what: str):
    def register(name: str):
        def add(f):
            if name in registry:
                raise ValueError(f"{what} {name} is registered already")
            registry[name] = f
            return f

        return add

    return register


register_process_reward, register_reward_model = _registering(PROCESS_REWARDS, "process reward"), _registering(REWARD_MODELS, "reward model")
register_process_reward("least")(least_process_reward)
register_process_reward("stated")(lambda text: F.coalesce(S.reward_value(text), F.lit(0.0)))
register_reward_model("scores")(lambda scores: F.coalesce(F.try_divide(F.aggregate(scores, F.lit(0.0), lambda a, v: a + v), F.size(scores)), F.lit(0.0)))
register_reward_model("generative")(mean_extracted)

# What a judging model is told, and the question it is asked.
JUDGE_SYSTEM = """
You are a process reward model, give the reward value of the answer, you must follow the instructions below:

1. Output a float reward value between -1.0 and 1.0, -1.0 means the worst answer, 1.0 means the best answer, please think step by step to give your reasons and thoughts, but the reward must appare at the end with this format: **Reward: your-reward-value**.

2. The answer may be incomplete, you must give the reward by the existing part of the answer, taking into account semantic coherence, logical correctness, and clarity.

3. A ground truth answer will be given to you, it may be not the best one, consider it as a reference example.

Begin!
"""
JUDGE_QUERY = """
The original question or the previous conversation:

#query#

Here is the ground truth as the reference:

#ground_truth#

Given the upper information, give your reward(-1.0~1.0) of the following answer:

#response#
"""


def judge_request(query: Column, truth: Column, response: Column) -> Column:
    """The messages that ask a model for the reward of an answer; NULL texts are empty."""
    text = F.lit(JUDGE_QUERY)
    for slot, value in (("#query#", query), ("#ground_truth#", truth), ("#response#", response)):
        text = F.replace(text, F.lit(slot), F.coalesce(value, F.lit("")))
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(JUDGE_SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), text.alias("content")))
