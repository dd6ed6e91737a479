import json
import re

from oracle import connect, same
from pyspark.sql import functions as F

from tessera.llm import canonical as C

MESSAGES = "array<struct<role:string,content:string>>"


def fold(text):
    """The same folding, one character at a time."""
    if text is None:
        return None
    text = text.upper().lower().replace("ς", "σ")
    alnum = lambda c: c.isalpha() or c.isnumeric()
    out = []
    i = 0
    while i < len(text):
        if alnum(text[i]):
            out.append(text[i])
            i += 1
            continue
        j = i
        while j < len(text) and not alnum(text[j]):
            j += 1
        if i and j < len(text) and text[i - 1].isnumeric() and text[j].isnumeric():
            out.append(re.sub(r"\s+", " ", text[i:j]))
        i = j
    return "".join(out)


def test_folding(spark):
    texts = ["Hello,  World!", "hello world", "3.5", "3 . 5", "35", "3\n\n5", "a1-2b - c", "GRÖSSE größe", "ΣΑΣ", "", " ", "!!", None, "中 文。", "x１２ 3", "1 — 2", "a\\b", "12\\\\34"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.folded(F.col("t"))).collect()]
    want = [None if t is None else re.sub(r"([\x00-\x02\\])", r"\\\1", fold(t)) for t in texts]
    assert got == want


def groups(df):
    return sorted((r["keep_id"], r["id"], r["copies"]) for r in C.grouped_copies(df).collect())


def test_chats_with_every_kind_of_row(spark):
    rows = [
        (5, [("user", "Hi there!")], "k"), (2, [("user", "hi  THERE")], None), (9, [("assistant", "hi there")], None), (3, None, None), (4, [], None), (6, [("user", None)], None), (7, [("user", "")], None),
        (8, [("user", None)], None), (10, [("user", "pay 1,000 now")], None), (11, [("user", "pay 1 000 now")], None), (12, [("user", "pay 1,000, now!")], None), (13, [("user", "x" * 300_000)], None), (14, [("user", "X" * 300_000 + ".")], None),
        (15, [None], None), (2, [("user", "hi there")], None),
    ]
    df = spark.createDataFrame(rows, f"sample_id long, messages {MESSAGES}, key string")
    assert groups(C.chat_records(df)) == sorted([(2, 2, 3), (2, 2, 3), (2, 5, 3), (9, 9, 1), (6, 6, 2), (6, 8, 2), (7, 7, 1), (10, 10, 2), (10, 12, 2), (11, 11, 1), (13, 13, 2), (13, 14, 2), (15, 15, 1)])
    assert groups(C.chat_records(df.limit(0))) == []


def test_lines(spark):
    line = lambda c, s="s", **k: json.dumps({"messages": [{"role": "user", "content": c}], "source": s, **k})
    rows = [(1, line("Hi!")), (2, '{ "source":"s",  "messages": [ {"content":"hi", "role":"user"} ] }'), (3, line("hi", "t")), (4, "  "), (5, None), (6, line("hi")[:-5]), (7, line("hi") + " {}"), (8, "[1]"), (9, line("hi", lang="en")), (10, line("hi"))]
    df = spark.createDataFrame(rows, "line_id long, raw string")
    assert groups(C.line_records(df)) == [(1, 1, 3), (1, 2, 3), (1, 10, 3), (3, 3, 1), (9, 9, 1)]


def test_hot_keys_take_the_salted_way(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT_ROWS", 50)
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 400).cast("string")).alias("key"))
    got = groups(df)
    by = {}
    for r in df.collect():
        by.setdefault(r["key"], []).append(r["id"])
    assert got == sorted((min(v), i, len(v)) for v in by.values() for i in v)
    assert sorted(map(tuple, C.collapsed(df).collect())) == sorted((min(v), len(v)) for v in by.values())
    assert sorted((r["keep_id"], r["id"]) for r in C.repeated(df).collect()) == sorted((min(v), i) for v in by.values() for i in v if i > min(v))


def test_hot_keys_are_few_and_no_task_holds_one(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT_ROWS", 10)
    monkeypatch.setattr(C, "HOT_KEYS", 3)
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "third").otherwise((F.col("id") % 150).cast("string")).alias("key"))
    copies = C.Copies(df)
    assert copies.bound > 60 and copies.groups.where(F.col("copies") >= copies.bound).count() == 1
    rows = copies.placed(copies.groups)
    assert rows.count() == 6000 and rows.where("keep_id = 0").count() == 2000


def test_ids_that_are_null_or_repeated(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (4, "b"), (4, "b"), (5, "b"), (None, "b")], "id long, key string")
    assert sorted(map(str, (tuple(r) for r in C.collapsed(df).collect()))) == ["(4, 4)", "(None, 2)"]
    assert [tuple(r) for r in C.repeated(df).collect()] == [(4, 5, 4)]


def test_queries_equal_their_sql(spark, small):
    duck = connect(small)
    for name, sql in C.SQL.items():
        same(getattr(C, name)(spark, small), duck, sql)
