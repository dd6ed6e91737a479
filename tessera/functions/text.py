"""Text functions as Column factories: everything stays in JVM expressions.

A NULL text gives NULL (predicates: NULL) unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What counts as blank at the ends of a text.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# ---- Fixed values: patterns whose matches decide what the cleaning pipeline drops ---------------------------
REFUSAL_PATTERNS = (
    r"\b(sorry|i apologize|i cannot|i'm unable)\b",
    r"\b(as an ai|as a language model)\b",
    r"(cannot provide|not able to|unable to (fulfill|complete|answer))",
)
TRUNCATION_MARKS = r"(未完待续|to be continued|continued\.{3}|\.{3}\s*$)"
SHORT_LAST_WORD = r"\s\w{1,4}$"
CLOSED_END = r"""[.!?"'\])。！？]$"""
ASKS_CODE = r"(write.*(code|function|program|script|class|def )|implement|```|import\s+\w+|def\s+\w+\()"
ASKS_MATH = r"(solve|calculate|compute|prove|derive|find the|evaluate|what is the (value|sum|product|result)|\\?frac|\\?sqrt)"
MATH_MARKS = (r"\\boxed\{", r"(?i)answer\s*[:=]\s*", r"(?i)therefore\b.*[.!]", r"(?i)the answer is\b", r"(?i)final answer\b")
CLEAN_CODE_END = r"(```\s*$|return\b.*\n|end\b.*\n|\}\s*$|\)\s*$|\]\s*$)"
PROSE_END = r"""[.!?"'。！？”’]\s*$"""


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: inside a lambda an outer expression is evaluated for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stripped(text: Column) -> Column:
    """``text`` without blanks of any kind at its ends."""
    return F.btrim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """The words between runs of blanks; an empty or blank text has none."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def normalised(text: Column) -> Column:
    """Lower case, blanks collapsed to single spaces, none at the ends."""
    return F.regexp_replace(stripped(F.lower(text)), r"(?U)\s+", " ")


def char_shingles(text: Column, n: int = 5) -> Column:
    """All substrings of n characters of the normalised text; none if it is shorter."""
    return let(
        normalised(text),
        lambda plain: F.when(F.length(plain) >= n, F.transform(F.sequence(F.lit(1), F.length(plain) - n + 1), lambda i: F.substring(plain, i, F.lit(n)))).otherwise(F.array().cast("array<string>")),
    )


def word_ngrams(text: Column, n: int) -> Column:
    """All runs of n words, joined by single spaces."""
    return let(
        words(text),
        lambda parts: F.when(F.size(parts) >= n, F.transform(F.sequence(F.lit(1), F.size(parts) - n + 1), lambda i: F.concat_ws(" ", *[F.element_at(parts, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>")),
    )


def is_refusal(response: Column) -> Column:
    """Whether the last 500 characters hold a refusal."""
    tail = F.right(stripped(response), F.lit(500))
    out = F.lit(False)
    for pattern in REFUSAL_PATTERNS:
        out = out | tail.rlike(f"(?iU){pattern}")
    return out


def is_truncated(response: Column) -> Column:
    """Whether the stripped text carries a mark of continuation or ends in a short word without closing."""
    text = stripped(response)
    return text.rlike(f"(?iUd){TRUNCATION_MARKS}") | (text.rlike(f"(?Ud){SHORT_LAST_WORD}") & ~text.rlike(f"(?d){CLOSED_END}"))


def asks_for_code(prompt: Column) -> Column:
    return stripped(prompt).rlike(f"(?iUd){ASKS_CODE}")


def asks_for_math(prompt: Column) -> Column:
    return stripped(prompt).rlike(f"(?iUd){ASKS_MATH}")


def open_brackets(text: Column) -> Column:
    """How many opening brackets never meet their closing one; unmatched closing brackets are ignored."""
    brackets = F.split(F.regexp_replace(text, r"[^\[\](){}]", ""), "")
    closing = F.create_map(*[F.lit(x) for pair in ("()", "[]", "{}") for x in pair])
    stack = F.aggregate(
        brackets,
        F.lit(""),
        lambda acc, c: F.when(c.isin("(", "[", "{"), F.concat(acc, closing[c])).when((c != "") & (F.right(acc, F.lit(1)) == c), F.left(acc, F.length(acc) - 1)).otherwise(acc),
    )
    return F.length(stack)


def is_complete_code(response: Column) -> Column:
    """Balanced brackets, or an ending that closes code."""
    return (open_brackets(stripped(response)) == 0) | stripped(response).rlike(f"(?Ud){CLEAN_CODE_END}")


def is_complete_math(response: Column) -> Column:
    text = stripped(response)
    out = F.lit(False)
    for pattern in MATH_MARKS:
        out = out | text.rlike(f"(?Ud){pattern}")
    return out


def is_complete_prose(response: Column) -> Column:
    return stripped(response).rlike(f"(?Ud){PROSE_END}")


def longest_run(text: Column) -> Column:
    """Length of the longest run of one character; 0 for an empty text."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)((.)\2*)"), 1), F.length)), F.when(text.isNotNull(), F.lit(0)))


def most_repeated_share(text: Column, n: int = 5) -> Column:
    """Share of the commonest n-gram of words among all; NULL for fewer than n words. For short texts; see
    ``operators.clean.ngram_repetition`` for the distributed form."""

    def share(grams: Column) -> Column:
        # runs of equal neighbours in sorted order, folded without a quadratic count
        folded = F.aggregate(
            F.array_sort(grams),
            F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")),
            lambda acc, g: let(
                F.when((acc["last"] == g) & (acc["run"] > 0), acc["run"] + 1).otherwise(1),
                lambda run: F.struct(g.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best")),
            ),
            lambda acc: acc["best"],
        )
        return F.when(F.size(grams) > 0, folded / F.size(grams))

    return let(word_ngrams(text, n), share)


def is_cjk(text: Column) -> Column:
    """Whether the text holds a CJK ideograph."""
    return text.rlike(r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]")


def file_kind(path: Column) -> Column:
    """image, audio, video or NULL by the extension of a path or URL."""
    extension = F.lower(F.substring_index(F.substring_index(path, "?", 1), ".", -1))
    return (
        F.when(extension.isin("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff"), "image")
        .when(extension.isin("mp3", "wav", "flac", "ogg", "m4a", "aac"), "audio")
        .when(extension.isin("mp4", "avi", "mov", "mkv", "webm", "flv"), "video")
    )


def exact_key(*parts: Column) -> Column:
    """md5 of the parts one after the other, without a separator; NULL parts are empty."""
    return F.md5(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]))
