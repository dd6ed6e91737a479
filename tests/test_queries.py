"""Every query over the engine's own operators against its SQL, on the smallest tables."""

import pytest
from oracle import connect, same

from tessera import queries as core

QUERIES, SQL = core.queries(), core.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, duck, name):
    same(QUERIES[name](spark, small), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


@pytest.mark.parametrize("name", ["bin_pack", "stream_bin_pack"])
def test_every_encoded_row_is_packed(spark, tmp_path, name):
    rows = [(1, [7] * 60, 60), (2, [7] * 2000, None), (3, [7] * 3000, None), (4, None, 2048), (5, None, None), (6, [], None), (7, [None] * 30, None), (8, [7] * 2500, 2500)]
    spark.createDataFrame(rows, "row_id long, input_ids array<int>, length int").coalesce(1).write.parquet(str(tmp_path / "encoded_rows.parquet"))
    got = QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["length"]) for r in got) == [(1, 60), (2, 2000), (3, 3000), (4, 2048), (7, 30), (8, 2500)]
    bins = {}
    for r in got:
        bins.setdefault((r["bin"], r["shard"] if "shard" in r else None), []).append(r["length"])
    assert all(sum(b) <= 2048 or len(b) == 1 for b in bins.values())


def test_every_number_is_text(spark, tmp_path):
    rows = [(i // 4, i % 4, i / 100) for i in range(100)] + [(100, 0, None), (0, 1, 0.01)]
    spark.createDataFrame(rows, "run_id long, step int, conf double").write.parquet(str(tmp_path / "draft_steps.parquet"))
    got = QUERIES["regression_to_text_all"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted({(r, s, f"{c:.1f}") for r, s, c in rows if c is not None})


def test_every_source_is_chunked_to_its_end(spark, tmp_path):
    from tessera.streaming import operators as O, run
    from tessera.streaming.operators import chunk

    texts = {"long": ["".join(map(chr, range(0x4E00, 0x4E00 + 2500)))], "short": ["abc" * 100], "same": ["x" * 700] * 3}
    rows = [(s, t) for s, ts in texts.items() for t in ts] + [(None, "n"), ("none", None)]
    spark.createDataFrame(rows, "source string, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = run.table_stream(spark, str(tmp_path), "documents").where("text IS NOT NULL AND source IS NOT NULL")
    got = O.closed(run.drained(O.chunked(pieces, "source", "text", 1000, 100, 100, rest=True)), "chunk").collect()
    assert sorted(map(tuple, got)) == sorted((s, *c) for s, ts in texts.items() for c in chunk("".join(ts), 1000, 100, 100))


def test_every_stated_value_is_scored(spark, small, tmp_path):
    ends = [("= 12$.", r"\boxed{12}", 1.0), ("= 12$.", r"\boxed{13}", 0.0), ("= 12$.", r"\boxed{", 0.0), ("= 12$.", "Therefore the answer is 12.", 0.0), ("= -3$.", r"\boxed{-3}", 1.0), ("= 2.50$.", r"\boxed{2.5}", 1.0)]
    ends += [(r"= \frac{1}{2}$.", r"\boxed{\frac{1}{2}}", 1.0), (r"= x + 1$.", r"\boxed{x+1}", 1.0), (r"= 2$.", r"\boxed{}", 0.0)]
    rows = [(i, [("user", "How many?"), ("assistant", f"Take $a {working} The result is {said}")]) for i, (working, said, _) in enumerate(ends)]
    rows += [(90, [("assistant", r"No working. \boxed{5}")]), (91, [("assistant", "$a = 5$."), ("user", "$a = 5$.")]), (92, None), (93, [("assistant", None)])]
    spark.createDataFrame(rows, "sample_id long, messages array<struct<role string, content string>>").write.parquet(str(tmp_path / "chats.parquet"))
    got = {r["sample_id"]: r["reward"] for r in QUERIES["answer_accuracy_all"](spark, str(tmp_path)).collect()}
    assert got == {i: reward for i, (_, _, reward) in enumerate(ends)}
    narrow, whole = (set(map(tuple, QUERIES[q](spark, small).collect())) for q in ("answer_accuracy", "answer_accuracy_all"))
    assert narrow < whole


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
