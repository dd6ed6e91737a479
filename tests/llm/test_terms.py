import numpy as np
from oracle import connect, same

from tessera.llm import terms as T


def test_terms_of():
    assert T.terms_of("Hello, WORLD's 3.5 中文abcかな x_y") == ["hello", "world", "s", "3", "5", "中", "文", "abc", "か", "な", "x", "y"]
    assert T.terms_of("・゛ー") == ["ー"]


def test_regex_is_letters_and_digits():
    import unicodedata

    for c in map(chr, range(0x3000, 0x30000, 7)):
        expected = unicodedata.category(c)[0] in "LN"
        assert bool(T.terms_of(c)) == expected or c.lower() != c


def test_columns_of_every_kind(spark, monkeypatch):
    monkeypatch.setattr(T, "FLUSH_TERMS", 2)  # counters begun anew all the time
    df = spark.createDataFrame(
        [([1, 1, 2, None], "a b a", ["a", None], [("u", "a"), ("u", None), None], "clash"), (None, None, None, None, None), ([], "", [], [], None), ([1], "A", ["b b"], [("u", "b a")], None), ([1], "A", ["b b"], [("u", "b a")], None)],
        "ids array<int>, text string, texts array<string>, messages array<struct<role:string,content:string>>, term string",
    )
    got = {(r["field"], r["term"]): (r["occurrences"], r["records"], r["all_records"], r["mark"]) for r in T.term_frequency(*[(df, c, c) for c in ("ids", "text", "texts", "messages")]).collect()}
    assert got == {
        ("ids", "1"): (4, 3, 3, "common"), ("ids", "2"): (1, 1, 3, "rare"), ("text", "a"): (4, 3, 3, "common"), ("text", "b"): (1, 1, 3, "rare"), ("texts", "a"): (1, 1, 3, "rare"), ("texts", "b"): (4, 2, 3, "rare"),
        ("messages", "a"): (3, 3, 3, "common"), ("messages", "b"): (2, 2, 3, "rare"),
    }
    assert T.term_frequency((df.limit(0), "ids", "x"), (df.limit(0), "text", "y")).count() == 0


def test_integers_across_batches():
    rng = np.random.default_rng(5)
    counters, plain = T.LastSeenIntegers(), T.LastSeen()
    for start in range(0, 60, 20):
        lists = [rng.integers(-3, 40, rng.integers(0, 30)) for _ in range(20)]
        counters.add(np.concatenate(lists), np.repeat(np.arange(start, start + 20), [len(x) for x in lists]))
        for k, values in enumerate(lists):
            plain.add(values.tolist(), start + k)
    counters.add(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    got, want = (sorted(zip(*(c.to_pylist() for c in x.batch().columns))) for x in (counters, plain))
    assert got == want


def test_long_text(spark):
    df = spark.createDataFrame([("word " * 200_000,)], "t string")
    assert [(r["term"], r["occurrences"], r["records"]) for r in T.term_frequency((df, "t", "t")).collect()] == [("word", 200_000, 1)]


def test_queries_equal_their_sql(spark, small):
    duck = connect(small)
    for name, sql in T.SQL.items():
        same(getattr(T, name)(spark, small), duck, sql)
