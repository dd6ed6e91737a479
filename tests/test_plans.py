import json

from tessera.plans import corpus


def line(prompt, response):
    return json.dumps({"messages": [{"role": "user", "content": prompt}, {"role": "assistant", "content": response}]})


def test_clean_files(spark, tmp_path):
    good = "The mill stands by the river and feeds the town with flour all year."
    rows = [line("Tell me about the mill.", good), line("Tell me about the mill.", good), line("What is it?", "short"), "{oops", "", json.dumps({"messages": []}), line("Tell me more please.", "I'm sorry, I cannot help you with any of this."), line("Another prompt here.", good + " And more was said of it.")]
    (tmp_path / "in.jsonl").write_text("\n".join(rows))
    report = {r["outcome"]: r["n"] for r in corpus.clean_files(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out")).collect()}
    assert report == {"kept": 2, "near_duplicate": 1, "too_short": 1, "refusal": 1, "malformed": 1, "no_pair": 1}
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_cleaning_is_idempotent(spark, small, tmp_path):
    chats = spark.read.parquet(f"{small}/chats.parquet").select("messages")
    chats.write.json(str(tmp_path / "a"))
    corpus.clean_files(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    again = {r["outcome"]: r["n"] for r in corpus.clean_files(spark, str(tmp_path / "b"), str(tmp_path / "c")).collect() if r["n"]}
    assert set(again) == {"kept"}


def test_training_rows(spark, small):
    rows = corpus.training_rows(spark.read.parquet(f"{small}/chats.parquet"), "sample_id", "chatml", 500, "Be brief.").collect()
    fill = {}
    for r in rows:
        fill[r["bin"]] = fill.get(r["bin"], 0) + r["length"]
    assert max(fill.values()) <= 500 and all("Be brief." in r["text"] for r in rows)
