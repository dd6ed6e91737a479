"""Boundaries of the cleaning rules."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import clean as C


def reason(spark, prompt, response):
    return spark.createDataFrame([(prompt, response)], "p string, r string").select(C.incomplete_reason(F.col("p"), F.col("r"))).first()[0]


LONG = "This answer is long enough to pass. "


@pytest.mark.parametrize(
    "prompt, response, want",
    [
        ("q", "123456789", "too_short"),
        ("q", "  123456789   \n", "too_short"),
        ("q", "1234567890.", None),
        ("q", None, "too_short"),
        ("q", LONG * 30 + "I'm sorry, no.", "refusal"),
        ("q", "sorry " + "word " * 120 + "the end is here.", None),
        ("q", "as an AI I will not do that.", "refusal"),
        ("q", LONG + "and so on...", "truncated"),
        ("q", LONG + "未完待续", "truncated"),
        ("q", LONG + "the quick brown fo", "truncated"),
        ("q", LONG + "ends with caffé", None),
        ("q", LONG + "ends with café", "truncated"),
        ("q", LONG + "ends with punctuation.", None),
        ("write a function", "def f(x): { unbalanced and unclean ending, really", "incomplete_code"),
        ("write a function", "def f(x) { return 1; }", None),
        ("write a function", "here: { ```\ncode\n```", None),
        ("write a function", "a stray ) closing bracket is ignored here.", None),
        ("compute 1+1", "it is surely two, is it not.", "incomplete_math"),
        ("compute 1+1", r"the value \boxed{2} it is.", None),
        ("compute 1+1", "so we have Answer: 2 at last.", None),
    ],
)
def test_first_reason(spark, prompt, response, want):
    assert reason(spark, prompt, response) == want


def test_refusal_comes_before_truncation(spark):
    assert reason(spark, "q", "I apologize, but this goes on...") == "refusal"


def test_repetition_boundaries(spark):
    rows = [
        (1, " ".join(["a"] * 19)),  # too few words
        (2, " ".join(["a"] * 20)),
        (3, "x" * 201),  # one word: not looked at
        (4, " ".join(f"w{i}" for i in range(25)) + " " + "x" * 201),
        (5, " ".join(f"w{i}" for i in range(25)) + " " + "x" * 200),
        (6, None),
    ]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "id int, t string").select("id", C.is_repetitive(F.col("t"))).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False}


@pytest.mark.parametrize("p, r, want", [(10, 10, None), (16000, 24000, None), (9, 10, "length_short"), (10, 9, "length_short"), (16001, 10, "length_long"), (10, 24001, "length_long")])
def test_length_bounds(spark, p, r, want):
    df = spark.createDataFrame([("x" * p, "y" * r)], "p string, r string")
    assert df.select(C.length_reason(F.col("p"), F.col("r"))).first()[0] == want


def test_longest_run_brackets_words(spark):
    df = spark.createDataFrame([("aab\n\n\n😀😀😀😀",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.longest_run(F.col("t"))).collect()] == [4, 0, None]
    df = spark.createDataFrame([("([{",), ("([{}])",), ("))((",), ("(]",)], "t string")
    assert [r[0] for r in df.select(T.open_brackets(F.col("t"))).collect()] == [3, 0, 2, 1]
    df = spark.createDataFrame([(" a b　c ",), ("  ",)], "t string")
    assert [r[0] for r in df.select(T.words(F.col("t"))).collect()] == [["a", "b", "c"], []]


def test_shingles(spark):
    df = spark.createDataFrame([(" AbC  dE ",), ("abc",)], "t string")
    assert [r[0] for r in df.select(T.char_shingles(F.col("t"))).collect()] == [["abc d", "bc de"], []]
    assert df.select(T.word_ngrams(F.lit("a b c d"), 3)).first()[0] == ["a b c", "b c d"]
