"""The cleaning of prompt and response pairs: filters with a reason for each dropped row."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import text as T
from tessera.operators import dedup
from tessera.runtime import spread, staged

# Bounds of the filters.
RESPONSE_MIN = 10
PROMPT_RANGE, RESPONSE_RANGE = (10, 16_000), (10, 24_000)
NGRAM, NGRAM_LEAST_WORDS, NGRAM_MAX_SHARE, LONGEST_RUN = 5, 20, 0.3, 200


def pair_by_position(df: DataFrame, messages: str = "messages") -> DataFrame:
    """Adds ``prompt`` and ``response``: the first and second message, whatever their roles; rows with fewer are dropped."""
    m = F.col(messages)
    return df.where(F.size(m) >= 2).withColumns({"prompt": m[0]["content"], "response": m[1]["content"]})


def pair_by_role(df: DataFrame, messages: str = "messages") -> DataFrame:
    """One row for each user message and the assistant message right after it: adds ``turn``, ``prompt``, ``response``."""
    m = F.col(messages)
    places = F.filter(F.sequence(F.lit(1), F.size(m) - 1), lambda i: (F.element_at(m, i)["role"] == "user") & (F.element_at(m, i + 1)["role"] == "assistant"))
    pairs = F.transform(places, lambda i: F.struct(F.element_at(m, i)["content"].alias("prompt"), F.element_at(m, i + 1)["content"].alias("response")))
    return df.where(F.size(m) >= 2).select("*", F.posexplode(pairs).alias("turn", "_pair")).select(*df.columns, "turn", "_pair.prompt", "_pair.response")


def incomplete_reason(prompt: Column, response: Column) -> Column:
    """The first reason in fixed order why a response is incomplete; NULL if there is none. NULL texts count as ''."""
    prompt, response = F.coalesce(prompt, F.lit("")), F.coalesce(response, F.lit(""))
    return (
        F.when(F.length(T.stripped(response)) < RESPONSE_MIN, "too_short")
        .when(T.is_refusal(response), "refusal")
        .when(T.is_truncated(response), "truncated")
        .when(T.asks_for_code(prompt) & ~T.is_complete_code(response), "incomplete_code")
        .when(T.asks_for_math(prompt) & ~T.is_complete_math(response), "incomplete_math")
    )


def is_repetitive(response: Column) -> Column:
    """Twenty words or more of which one 5-gram makes more than 30 %, or a run of more than 200 equal characters."""
    response = F.coalesce(response, F.lit(""))
    return (F.size(T.words(response)) >= NGRAM_LEAST_WORDS) & (
        (T.most_repeated_share(response, NGRAM) > NGRAM_MAX_SHARE) | response.rlike(rf"(?s)(.)\1{{{LONGEST_RUN}}}")
    )


def length_reason(prompt: Column, response: Column) -> Column:
    """Whether a text, unstripped, lies outside its inclusive bounds."""
    p, r = F.length(F.coalesce(prompt, F.lit(""))), F.length(F.coalesce(response, F.lit("")))
    return F.when((p < PROMPT_RANGE[0]) | (r < RESPONSE_RANGE[0]), "length_short").when((p > PROMPT_RANGE[1]) | (r > RESPONSE_RANGE[1]), "length_long")


#: What is no blank for ``text.words``.
_NO_BLANKS = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _commonest(n: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, words_, grams, top = [], [], [], []
            for k, text in enumerate(batch.column(1)):  # one text at a time, however long
                words = _NO_BLANKS.findall(text.as_py() or "")
                if len(words) >= n:
                    counts = Counter(zip(*(words[i:] for i in range(n))))
                    row.append(k)
                    words_.append(len(words))
                    grams.append(len(words) - n + 1)
                    top.append(max(counts.values()))
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(words_, pa.int64()), pa.array(grams, pa.int64()), pa.array(top, pa.int64())], names=["id", "n_words", "n_grams", "top_count"])

    return count


def ngram_repetition(df: DataFrame, id_column: str, text: Column, n: int = NGRAM) -> DataFrame:
    """``id, n_words, n_grams, top_count, share`` of each text with at least n words: its commonest n-gram of words.

    A text lies in one row and is counted there; nothing is shuffled. NULL texts and shorter ones give no rows.
    """
    rows = spread(df.select(F.col(id_column).alias("id"), text.alias("text")))
    counted = rows.mapInArrow(_commonest(n), f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_grams long, top_count long")
    return counted.select("*", (F.col("top_count") / F.col("n_grams")).alias("share"))


def clean(df: DataFrame, id_column: str, threshold: float = dedup.THRESHOLD) -> DataFrame:
    """``id, outcome`` of every row of ``df (id, prompt, response)``: 'kept', or the stage or reason that drops it.

    The stages run in fixed order: near duplicates first (the smallest id of a cluster survives, good or bad), then
    incompleteness, repetition, length, and exact duplicates among what is left. Each text is judged where it lies; what
    meets the clusters is an id, a reason and a digest.
    """
    p, r = F.col("prompt"), F.col("response")
    whole = F.concat(F.coalesce(p, F.lit("")), F.lit(" "), F.coalesce(r, F.lit("")))
    clusters = dedup.near_duplicate_clusters(df, id_column, whole, threshold)
    reason = F.coalesce(incomplete_reason(p, r), F.when(is_repetitive(r), "repetitive"), length_reason(p, r))
    alone = staged(spread(df.select(F.col(id_column).cast("long").alias("id"), "prompt", "response")).select("id", reason.alias("reason"), F.unhex(T.exact_key(p, r)).alias("key")))
    judged = alone.join(clusters, "id").select("id", F.when(F.col("cluster") != F.col("id"), "near_duplicate").otherwise(F.col("reason")).alias("reason"), "key")
    left = judged.where("reason IS NULL").select("id", "key")
    first = left.groupBy("key").agg(F.min("id").alias("first"))
    later = left.join(first.where("first IS NOT NULL"), "key").where("id <> first").select("id", F.lit("duplicate").alias("outcome"))
    return judged.select("id", "reason").join(later, "id", "left").select("id", F.coalesce("reason", "outcome", F.lit("kept")).alias("outcome"))
