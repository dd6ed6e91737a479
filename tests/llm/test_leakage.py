import random
import re

from oracle import connect, same

from tessera.llm import leakage as K

WORD = re.compile(r"[^\W_]+")
MESSAGES = "array<struct<role:string,content:string>>"


def windows(text):
    words = WORD.findall(text.casefold())
    out = {tuple(words[i : i + 12]) for i in range(len(words) - 11)}
    for run in re.findall(rf"[{K.HAN}\d]+", re.sub(r"[\W_]+", "", text.casefold())):
        out |= {run[i : i + 20] for i in range(len(run) - 19) if not run[i : i + 20].isdigit()}
    return out


def brute(items, rows):
    return sorted({(q, s) for q, turns in items for s, ms in rows if q is not None and s is not None for t in turns or () for m in ms or () if t and m and m[1] and windows(t) & windows(m[1])})


def run(spark, items, rows):
    i = spark.createDataFrame([(q, t, "x") for q, t in items], "question_id long, turns array<string>, row string")
    c = spark.createDataFrame([(s, m, 1) for s, m in rows], f"sample_id long, messages {MESSAGES}, item int")
    return sorted((r["question_id"], r["sample_id"]) for r in K.leaked_items(i, c).collect())


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary, han = [f"w{i}" for i in range(30)], [chr(0x4E00 + i) for i in range(12)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, [sentence(rng.randrange(5, 40)), "".join(rng.choice(han) for _ in range(40))]) for i in range(25)]
    rows = []
    for s in range(120):
        q = rng.choice(items)[1]
        words = q[0].split()
        at = rng.randrange(len(words))
        part = words[at : at + rng.randrange(9, 16)]
        chinese = q[1][rng.randrange(25) :][: rng.randrange(17, 24)]
        rows.append((s, [("user", sentence(6) + ", " + "; ".join(part).upper() + " - " + sentence(4)), ("assistant", "前" + "，".join(chinese) + "后")]))
    assert run(spark, items, rows) == brute(items, rows)
    monkeypatch.setattr(K, "BLOCK_CHARACTERS", 100)  # too many items for a broadcast
    assert run(spark, items, rows) == brute(items, rows)


def test_edges(spark, monkeypatch):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = [(1, [text]), (2, [None, ""]), (3, None), (None, [text]), (1, [text]), (4, ["1" * 30]), (5, [])]
    rows = [
        (1, [("user", "ONE, two-three; four five six\nseven eight nine ten eleven twelve!")]), (2, [("user", "one two three four five six seven eight nine ten eleven")]), (3, None), (4, []), (5, [None, ("user", None)]),
        (None, [("user", text)]), (6, [("user", "1" * 30)]), (7, [("user", "x " * 100_000 + text)]), (1, [("user", text)]), (8, [("user", "one two three four five six"), ("user", "seven eight nine ten eleven twelve")]),
    ]
    for characters in (K.BLOCK_CHARACTERS, 0):
        monkeypatch.setattr(K, "BLOCK_CHARACTERS", characters)
        assert run(spark, items, rows) == [(1, 1), (1, 7)]
        assert run(spark, [], rows) == [] and run(spark, items, []) == []


def test_a_window_of_many_rows_is_dealt(spark, monkeypatch):
    """A passage in a third of all rows, with items joined by shuffle and a bitmap so small that much passes it."""
    monkeypatch.setattr(K, "BLOCK_CHARACTERS", 0)
    monkeypatch.setattr(K, "BITMAP_BITS", 8)
    text = " ".join(f"word{i}" for i in range(14))
    items = [(1, [text]), (2, ["x " + text]), (3, [" ".join(f"other{i}" for i in range(14))])]
    rows = [(s, [("user", text if s % 3 == 0 else f"row {s} has nothing of it, only word1 word2 word3 word4 and the rest")]) for s in range(3300)]
    assert run(spark, items, rows) == [(q, s) for q in (1, 2) for s in range(0, 3300, 3)]


def test_query_equals_its_sql(spark, small):
    same(K.p4_found(spark, small), connect(small), K.SQL["p4_found"])


def test_p4_on_the_tables(spark, small, monkeypatch):
    questions, chats = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("questions", "chats"))
    items = [(r["question_id"], r["turns"]) for r in questions.collect()]
    rows = [(r["sample_id"], [m and (m["role"], m["content"]) for m in r["messages"] or ()]) for r in chats.collect()]
    index = {}
    for q, turns in items:
        for t in turns or ():
            for w in windows(t or ""):
                index.setdefault(w, set()).add(q)
    want = {(q, s) for s, ms in rows for m in ms if m and m[1] for w in windows(m[1]) for q in index.get(w, ())}
    for characters in (K.BLOCK_CHARACTERS, 1000):
        monkeypatch.setattr(K, "BLOCK_CHARACTERS", characters)
        assert {(r["question_id"], r["sample_id"]) for r in K.p4_found(spark, small).collect()} == want
