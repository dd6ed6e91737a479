"""Readers, writers, the catalogue and streams over files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import catalog, readers, sinks
from tessera.streaming import operators as O, run


def write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_jsonl_round_trip_keeps_unicode(spark, tmp_path):
    df = spark.createDataFrame([("é中😀", [1.5, None])], "a string, b array<double>")
    sinks.jsonl(df, str(tmp_path / "o"))
    assert "é中😀" in "".join(p.read_text("utf-8") for p in (tmp_path / "o").glob("part-*"))
    assert readers.jsonl(spark, str(tmp_path / "o"), "a string, b array<double>").collect() == df.collect()
    sinks.jsonl(df, str(tmp_path / "o"), "append")
    assert readers.jsonl(spark, str(tmp_path / "o"), "a string").count() == 2


def test_strict_reader_fails_and_tolerant_one_counts(spark, tmp_path):
    p = write(tmp_path / "x.jsonl", ['{"a": 1}', "", "{oops", '{"a": 2} trailing', "[1]", '{"a": "wrong type"}'])
    with pytest.raises(Exception):
        readers.jsonl(spark, p, "a int").collect()
    good, bad = readers.jsonl_tolerant(spark, p, "a int")
    assert [r["a"] for r in good.collect()] == [1]
    assert bad.count() == 4


def test_categories_by_file(spark, tmp_path):
    write(tmp_path / "math.jsonl", ['{"q": 1}'])
    write(tmp_path / "code.jsonl", ['{"q": 2, "category": "own"}'])
    write(tmp_path / "math_answer.jsonl", ['{"q": 3}'])
    rows = readers.by_category(spark, str(tmp_path / "*.jsonl"), "q int, category string").collect()
    assert sorted((r["q"], r["category"]) for r in rows) == [(1, "math"), (2, "own")]


def test_tsv_with_byte_order_mark_and_nli(spark, tmp_path):
    p = tmp_path / "x.tsv"
    p.write_bytes("﻿language\tsentence1\tsentence2\tgold_label\nen\ta\tb\tcontradictory\nde\tc\td\tneutral\n".encode())
    rows = readers.nli_pairs(readers.tsv(spark, str(p), ["language", "sentence1", "sentence2", "gold_label"]), "en").collect()
    assert [(r["text_a"], r["text_b"], r["label"]) for r in rows] == [("a", "b", "contradiction")]


def test_server_events_and_archives(spark, tmp_path):
    df = spark.createDataFrame([('data: {"x": 1}',), ("",), ("data: [DONE]",)], "l string")
    assert [r["x"] for r in readers.server_events(df, "l", "x int").collect()] == [1]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("failures_line.txt", "one\ntwo\n")
    (tmp_path / "b.zip").write_bytes(b"no zip")
    rows = readers.archives(spark, str(tmp_path / "*.zip"), ("failures_line.txt", "missing.txt")).collect()
    assert [(r["line_no"], r["line"]) for r in sorted(rows, key=lambda r: r["line_no"])] == [(0, "one"), (1, "two")]


def test_sample_cache_skips_missing_folders(spark, tmp_path):
    assert readers.sample_cache(spark, [str(tmp_path / "none")]).count() == 0
    write(tmp_path / "c.jsonl", ['{"id": "a", "choices": ["1"]}', '{"id": "a", "choices": ["2"]}'])
    assert sorted(readers.sample_cache(spark, [str(tmp_path / "none"), str(tmp_path / "c.jsonl")]).first()["choices"]) == ["1", "2"]


def test_resumable_and_sharded(spark, tmp_path):
    out = str(tmp_path / "r")
    assert sinks.resumable(spark.range(5), out, "id") == 5
    assert sinks.resumable(spark.range(8), out, "id") == 3
    assert sinks.resumable(spark.range(8), out, "id") == 0
    assert spark.read.parquet(out).count() == 8
    moved = sinks.set_aside(spark, out)
    assert spark.read.parquet(moved).count() == 8 and sinks.set_aside(spark, out) is None
    sinks.sharded(spark.range(100).coalesce(1), str(tmp_path / "s"), 30)
    assert len(list((tmp_path / "s").glob("*.parquet"))) == 4


def test_answers_and_store(spark, tmp_path):
    a = sinks.answers(spark.range(2), "id", F.array(F.lit("x")), "model").collect()
    assert len({r["answer_id"] for r in a}) == 2 and len(a[0]["answer_id"]) == 32
    t = spark.createDataFrame([(1, {"a": 1})], "id int, metadata map<string,int>")
    sinks.benchmark_store(t, t, t, str(tmp_path / "b"))
    assert json.loads(spark.read.parquet(str(tmp_path / "b/benchmarks")).first()["metadata"]) == {"a": 1}
    sinks.by_category(spark.createDataFrame([("a/b c", 1)], "c string, x int"), "c", str(tmp_path / "k"))
    assert (tmp_path / "k" / "_folder=a_b_c").is_dir()


def test_catalogue(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "d"))
    catalog.register(catalog.Dataset("numbers", str(tmp_path / "d"), subsets={"same": str(tmp_path / "d")}, tags=("t",)))
    assert catalog.load(spark, "numbers").count() == 10
    assert catalog.load(spark, "numbers:same#25", "id").count() == 25
    assert catalog.names("t") == ["numbers"]
    with pytest.raises(ValueError):
        catalog.register(catalog.Dataset("numbers", "x"))
    with pytest.raises(KeyError):
        catalog.load(spark, "nothing")
    catalog.register_json('[{"name": "rel", "path": "d"}]', str(tmp_path))
    assert catalog.load(spark, "rel").count() == 10


def test_streams_carry_state_between_batches(spark, tmp_path):
    for i, rows in enumerate(([(1, 60), (2, 60)], [(3, 30), (4, None), (5, 500)])):
        spark.createDataFrame(rows, "id long, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "p.parquet"))
    packed = O.closed_rows(run.drained(O.packed(run.table_stream(spark, str(tmp_path), "p", 1), "id", "n", 100, shards=1, rest=True)), "shard", "id").collect()
    assert sorted(r["id"] for r in packed) == [1, 2, 3]
    fill = {}
    for r in packed:
        fill[r["bin"]] = fill.get(r["bin"], 0) + r["length"]
    assert max(fill.values()) <= 100 and len(fill) == 2  # the carried bin took the third row


def test_chunks_agree_with_the_loop(spark):
    texts = ["", "abc", "abcdefghij", "abcdefghijklmnopqrstuvwxyz", "x" * 57]
    for size, left, right in ((10, 2, 2), (8, 0, 0), (5, 3, 1)):
        df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", O.chunks(F.col("t"), size, left, right).alias("c"))
        for r in df.collect():
            assert [(c["chunk"], c["left"], c["right"]) for c in r["c"]] == O.chunk(r["t"], size, left, right)


def test_text_is_emitted_at_boundaries(spark, tmp_path):
    for i, piece in enumerate(("hel", "lo wor", "ld\n", "中")):
        spark.createDataFrame([("k", piece)], "k string, t string").coalesce(1).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    out = run.drained(O.emitted(run.table_stream(spark, str(tmp_path), "t"), "k", "t")).collect()
    assert all(r["text"].endswith((" ", "\n", "中")) for r in out)


def test_streams_give_what_is_left_at_the_end(spark, tmp_path):
    alphabet = "".join(map(chr, range(0x4E00, 0x4E00 + 57)))
    for texts in ({"a": alphabet[:23], "b": "xy", "c": "0123456789"}, {"a": alphabet[23:41], "b": "z", "d": "q"}, {"a": alphabet[41:], "e": None}):
        spark.createDataFrame([(k, t) for k, t in texts.items()], "k string, t string").coalesce(1).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    whole = {"a": alphabet, "b": "xyz", "c": "0123456789", "d": "q", "e": ""}
    for size, left, right in ((10, 2, 2), (8, 0, 0), (5, 3, 1)):
        out = O.closed(run.drained(O.chunked(run.table_stream(spark, str(tmp_path), "t", 1), "k", "t", size, left, right, rest=True)), "chunk").collect()
        assert sorted(map(tuple, out)) == sorted((k, *c) for k, t in whole.items() for c in O.chunk(t, size, left, right))
    out = O.closed(run.drained(O.emitted(run.table_stream(spark, str(tmp_path), "t", 1), "k", "t", rest=True)), "text").collect()
    assert {k: sum(len(r["text"]) for r in out if r["key"] == k) for k in "abcde"} == {k: len(t) for k, t in whole.items()}


def test_cached_and_projected(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert readers.cached(spark, str(tmp_path / "c"), build).count() == 3
    readers.cached(spark, str(tmp_path / "c"), build, overwrite=True)
    assert len(made) == 2
    assert readers.projected(spark.range(1).withColumn("x", F.lit(1)), ["x", "missing", "id"]).columns == ["x", "id"]


def test_shuffled_batches_keep_every_row(spark, tmp_path):
    for i in range(2):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    got = run.shuffled_batches(run.table_stream(spark, str(tmp_path), "t", 1), "id", 1).collect()
    assert sorted(r["id"] for r in got) == list(range(20)) and {r["batch"] for r in got} == {0, 1}


def test_cyclic_source(spark):
    stream = run.cyclic(spark, spark.range(3), "id", 50)
    query = stream.writeStream.format("memory").queryName("cyclic").start()
    try:
        for _ in range(60):
            query.processAllAvailable()
            if spark.table("cyclic").where("round >= 1").count():
                break
        assert {r["id"] for r in spark.table("cyclic").collect()} == {0, 1, 2}
    finally:
        query.stop()


def test_rows_are_found_by_number(spark, tmp_path):
    from tessera.sources import readers, sinks

    df = spark.range(500).select((499 - F.col("id")).alias("k"), F.col("id").cast("string").alias("t"))
    sinks.indexed(df, str(tmp_path / "i"), "k", rows_per_file=50)
    at = lambda n: [(r["row_no"], r["k"]) for r in readers.rows_at(spark, str(tmp_path / "i"), n).orderBy("row_no").collect()]
    assert at([7, 499, 1000]) == [(7, 7), (499, 499)] and at((10, 13)) == [(10, 10), (11, 11), (12, 12)] and at([]) == []


def test_stored_runs_get_keys(spark, tmp_path):
    from tessera.sources import sinks

    for n, first in ((2, 0), (3, 2)):
        runs = spark.createDataFrame([(f"r{i}", {"a": i}) for i in range(n)], "name string, other map<string,int>")
        measures = spark.createDataFrame([("r0", 1.5), ("r1", 2.5), ("r0", 3.5)], "name string, value double")
        stored = sinks.benchmark_store(runs, measures, measures, str(tmp_path / "s"), order="name")
        assert {r["name"]: r["benchmark_id"] for r in stored.collect()} == {f"r{i}": first + i for i in range(n)}
    kept = spark.read.parquet(str(tmp_path / "s" / "model_measurements"))
    assert sorted((r["benchmark_id"], r["value"]) for r in kept.collect()) == [(0, 1.5), (0, 3.5), (1, 2.5), (2, 1.5), (2, 3.5), (3, 2.5)]


def test_contents_of_any_kind_become_text(spark):
    from tessera.operators import messages as M

    df = spark.createDataFrame([([("tool", {"a": 1}), ("tool", None)],)], "m array<struct<role:string,content:map<string,int>>>").select(M.text_content(F.col("m")).alias("m"))
    assert [tuple(x) for x in df.first()["m"]] == [("tool", '{"a":1}'), ("tool", None)]
    df = spark.createDataFrame([([("user", 'say "hi"\n')],)], "m array<struct<role:string,content:string>>").select(M.text_content(F.col("m")).alias("m"))
    assert df.first()["m"][0]["content"] == 'say "hi"\n'
