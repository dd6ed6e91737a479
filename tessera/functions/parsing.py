"""Parsing of model output: answers, rewards, tool calls, marked sections."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType


def boxed(text: Column) -> Column:
    """What stands in the first ``\\boxed{...}`` up to the next brace; the whole text if there is none."""
    found = F.regexp_extract(text, r"\\boxed\{([^}]*)\}", 1)
    return F.when(text.rlike(r"\\boxed\{[^}]*\}"), F.btrim(found, F.lit(" \t\n\r"))).otherwise(text)


def after(text: Column, mark: str) -> Column:
    """What follows the first mark up to the next one; the whole text without a mark."""
    return F.when(text.contains(mark), F.split_part(text, F.lit(mark), F.lit(2))).otherwise(text)


def plain_latex(text: Column) -> Column:
    """LaTeX without math delimiters and braces."""
    return F.btrim(F.regexp_replace(F.replace(F.regexp_replace(text, r"\\\(|\\\)|\\\[|\\]", ""), F.lit("}}"), F.lit("}")), r"[{}]", ""), F.lit(" \t\n\r"))


def same_answer(said: Column, wanted: Column) -> Column:
    """Equality of final answers: as numbers where both are, else as normalised text. (No symbolic algebra.)"""
    a, b = (F.lower(F.regexp_replace(plain_latex(boxed(after(x, "# Answer"))), r"(?U)[\s,$]+", "")) for x in (said, wanted))
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.coalesce(F.abs(x - y) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(y)), a == b)


def reward_value(text: Column) -> Column:
    """The number after ``Reward:``, or in brackets; NULL if there is none."""
    return F.coalesce(F.regexp_extract(text, r"Reward:\s*\[?\s*([-+]?\d*\.?\d+)", 1), F.lit("")).try_cast("double")


def action_of(text: Column) -> Column:
    """Struct of ``action`` and ``input``: after the last marks of the ReAct format; 'none' and '{}' without them."""
    said = F.when(text.contains("Action:"), F.substring_index(text, "Action:", -1))
    action = F.when(said.isNotNull(), F.btrim(F.substring_index(said, "Action Input:", 1), F.lit(" \t\n\r"))).otherwise("none")
    given = F.when(text.contains("Action Input:"), F.btrim(F.substring_index(text, "Action Input:", -1), F.lit(" \t\n\r"))).otherwise("{}")
    return F.struct(action.alias("action"), given.alias("input"))


def think_answer_format(text: Column) -> Column:
    """1.0 if a text is a reasoning block and then an answer block and nothing else, else 0.0."""
    return F.when(text.rlike(r"(?s)\A<think>.*?</think>\s*<answer>.*?</answer>\z"), 1.0).otherwise(0.0)


def think_action_format(text: Column) -> Column:
    return F.when(text.rlike(r"(?s)\A<think>.*?</think>\s*Action:.*?Action Input:.*"), 1.0).otherwise(0.0)


def tool_calls(text: Column) -> Column:
    """Bodies of all ``<tool_call>`` blocks."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(.+?)\s*</tool_call>"), 1), lambda x: x)


@F.pandas_udf(ArrayType(StructType([StructField("name", StringType()), StructField("arguments", StringType())])))
def parsed_tool_calls(text: pd.Series) -> pd.Series:
    """Name and arguments (JSON) of the tool calls of a text: tagged blocks, or a bare JSON object with a name."""
    out = []
    for t in text:
        calls = []
        for block in re.findall(r"<tool_call>\s*(.+?)\s*</tool_call>", t or "", re.S) or ([t] if t else []):
            value = _lenient(block)
            if isinstance(value, dict) and "name" in value:
                arguments = value.get("arguments", value.get("parameters", {}))
                calls.append({"name": str(value["name"]), "arguments": arguments if isinstance(arguments, str) else json.dumps(arguments, ensure_ascii=False)})
        out.append(calls)
    return pd.Series(out)


def _lenient(text: str):
    """JSON, or a Python literal; None if neither."""
    try:
        return json.loads(text)
    except ValueError:
        try:
            return ast.literal_eval(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None


@F.pandas_udf(StringType())
def lenient_json(text: pd.Series) -> pd.Series:
    """JSON of a text that is JSON or a Python literal; NULL if neither."""
    return pd.Series([None if t is None or (v := _lenient(t)) is None else json.dumps(v, ensure_ascii=False, sort_keys=True, default=str) for t in text])


@F.pandas_udf(StringType())
def sanitised_json(text: pd.Series) -> pd.Series:
    """JSON with the values of keys that end in ``_token`` (secrets) set to null, at any depth; NULL for invalid JSON."""
    def clean(v):
        if isinstance(v, dict):
            return {k: None if k.endswith("_token") else clean(x) for k, x in v.items()}
        return [clean(x) for x in v] if isinstance(v, list) else v

    out = []
    for t in text:
        try:
            out.append(None if t is None else json.dumps(clean(json.loads(t)), ensure_ascii=False))
        except ValueError:
            out.append(None)
    return pd.Series(out)


def quoted(literal: str) -> str:
    """A text as a regular expression of the JVM that matches nothing but it."""
    return re.sub(r"([^\w\s])", r"\\\1", literal, flags=re.A) if literal.isascii() else "".join(c if c.isalnum() or ord(c) > 127 or c.isspace() else f"\\{c}" for c in literal)


def sections(delimiters: list[str], regex: bool = False):
    """A function splitting a text at delimiters into ``array<struct<key, content>>``; leading text has the key ''.

    The contents with their delimiters add up to the text. The longest of literal delimiters wins where several begin;
    regular expressions must have no groups of their own and match at least one character. NULL gives NULL.
    """
    marks = "|".join(delimiters if regex else map(quoted, sorted(delimiters, key=len, reverse=True)))
    pattern = F.lit(rf"(?s)({marks}|\A)(.*?)(?={marks}|\z)")

    def cut(text: Column) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("key"), F.regexp_extract_all(text, pattern, 2).alias("content"))
        return F.filter(pairs, lambda p: (p["key"] != "") | (p["content"] != ""))

    return cut


def first_value(document: Column) -> Column:
    """The first value of a JSON document that is neither null, empty, false nor 0, however deep it is nested; NULL if none is."""
    text = r'"(?:[^"\\]|\\.)*"'
    found = F.regexp_extract_all(document, F.lit(rf"{text}\s*:|({text}|-?\d[\d.eE+-]*|true)"), 1)  # keys are matched, but not taken
    kept = F.filter(found, lambda v: ~v.isin("", '""') & ~F.coalesce(v.try_cast("double") == 0, F.lit(False)))
    first = F.get(kept, F.lit(0))
    return F.when(first.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), first, F.lit("}")), "$.v")).otherwise(first)


# ---- equality of mathematical answers --------------------------------------------------------------------------
_LATEX = (  # fixed values: LaTeX that stands for a sign or for nothing
    (r"\\(?:left|right|displaystyle|,|;|!|quad|text\{[^{}]*\}|mathrm\{[^{}]*\})", ""), (r"\\(?:cdot|times)", "*"), (r"\\div", "/"), (r"\\(?:dfrac|tfrac)", r"\\frac"), (r"\\pi", "pi"), (r"\\infty", "inf"), (r"\\%", "%"), (r"\\\$|\$", ""),
)


def _expression(text: str) -> str:
    """LaTeX of numbers as an expression of Python."""
    for pattern, by in _LATEX:
        text = re.sub(pattern, by, text)
    for _ in range(20):  # from the innermost braces outwards
        new = re.sub(r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"((\1)/(\2))", text)
        new = re.sub(r"\\frac\s*(\d)\s*(\d)", r"((\1)/(\2))", new)
        new = re.sub(r"\\sqrt\s*\{([^{}]*)\}", r"((\1)**0.5)", new)
        new = re.sub(r"\\sqrt\s*(\d)", r"((\1)**0.5)", new)
        new = re.sub(r"\^\s*\{([^{}]*)\}", r"**(\1)", new)
        if new == text:
            break
        text = new
    text = re.sub(r"(\d+(?:\.\d+)?)\s*%", r"((\1)/100)", text.replace("^", "**"))
    return re.sub(r"(?<=[\d)])\s*(?=\(|pi)", "*", re.sub(r"(?<=\d),(?=\d{3}\b)", "", text))


def _number(text: str) -> float | None:
    """The value of an expression of numbers; None if it is anything else."""
    import math
    import operator

    steps = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow}

    def value(node) -> float:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return float(node.value)
        if isinstance(node, ast.Name) and node.id in ("pi", "inf"):
            return getattr(math, node.id)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -value(node.operand) if isinstance(node.op, ast.USub) else value(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in steps:
            return steps[type(node.op)](value(node.left), value(node.right))
        raise ValueError

    try:
        out = value(ast.parse(_expression(text).strip(), mode="eval").body)
        return out if isinstance(out, float) else None
    except (ValueError, SyntaxError, ArithmeticError, MemoryError, RecursionError):
        return None


def _parts(text: str) -> list[str]:
    """What commas outside brackets separate."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0:
            out.append(text[at:i])
            at = i + 1
    return [*out, text[at:]]


def _equal_answers(a: str, b: str) -> bool:
    a, b = (re.sub(r"\\[()\[\]]", "", x).strip().strip("$").strip().rstrip(".") for x in (a, b))
    a, b = (re.sub(r"^(?:[A-Za-z]\w*\s*(?:=|\\in)\s*)", "", x) for x in (a, b))  # x = 3
    x, y = _number(a), _number(b)
    if x is not None and y is not None:
        return x == y or abs(x - y) <= 1e-9 * max(1.0, abs(y))
    if (x is None) != (y is None):
        return False
    plain = [re.sub(r"\\left|\\right|\s+", "", t) for t in (a, b)]
    sets = [re.fullmatch(r"\\\{(.*)\\\}", t) for t in plain]
    if all(sets):
        left, right = (_parts(m[1]) for m in sets)
        return len(left) == len(right) and all(any(_equal_answers(p, q) for q in right) for p in left) and all(any(_equal_answers(p, q) for p in left) for q in right)
    pairs = [re.fullmatch(r"([(\[])(.*)([)\]])", t) for t in plain]  # intervals and points
    if all(pairs):
        left, right = (_parts(m[2]) for m in pairs)
        return (pairs[0][1], pairs[0][3]) == (pairs[1][1], pairs[1][3]) and len(left) == len(right) and all(map(_equal_answers, left, right))
    return re.sub(r"[{}\s]", "", plain[0]).lower() == re.sub(r"[{}\s]", "", plain[1]).lower()


@F.pandas_udf(BooleanType())
def equal_mathematics(said: pd.Series, wanted: pd.Series) -> pd.Series:
    """Whether two answers are the same number (fractions, roots, powers, percentages), set, interval or point, or else text.

    Letters are compared as text: there is no symbolic algebra. NULL gives NULL.
    """
    return pd.Series([None if a is None or b is None else _equal_answers(a, b) for a, b in zip(said, wanted)], dtype="object")


def boxed_whole(text: Column) -> Column:
    """What stands in the first ``\\boxed{...}`` with its nested braces, up to three deep; the whole text if there is none."""
    inner = r"[^{}]*"
    for _ in range(3):
        inner = rf"(?:[^{{}}]|\{{{inner}\}})*"
    return F.when(text.rlike(rf"\\boxed\{{{inner}\}}"), F.regexp_extract(text, rf"\\boxed\{{({inner})\}}", 1)).otherwise(text)
