import pytest
from pyspark.sql import functions as F

from tessera.llm import language as L

EN = "The quiet mill stands near the river and the people of the town wait for the ferry."
DE = "Die stille Mühle steht an dem Fluss, und die Leute aus der Stadt warten auf die Fähre."
FR = "Le vieux moulin se trouve près de la rivière et les gens du village attendent le bac."
ZH = "没有人知道城北的图书馆为什么在霜降之前公开展示整条山路，而河对岸的集市记录下每天的读数。"


@pytest.fixture(scope="module")
def scorer(spark):
    root = "/root/testdata/sf0.01"
    chats, documents = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("chats", "documents"))
    return L.fit(L.training_sample((chats, "sample_id", "lang", F.col("messages.content")), (documents, "doc_id", "lang", F.array("text"))))


def languages(scorer, text):
    found = L.segments(scorer, [L._prose(text)])[0]
    return None if found is None else [(s[0], s[2]) for s in found if s[5]]


def test_single_and_mixed_texts(scorer):
    assert languages(scorer, EN) == [("en", 0)]
    assert languages(scorer, f"{EN} {DE} {EN}") == [("en", 0), ("de", 1), ("en", 2)]
    assert languages(scorer, f"{ZH}\n{FR}") == [("zh", 0), ("fr", 1)]
    assert languages(scorer, EN.upper()) == [("en", 0)]
    assert languages(scorer, EN.replace(" ", "\n")) == [("en", 0)]


def test_what_tells_no_language(scorer):
    assert languages(scorer, "In Tarwinor people call this “saudade”, and the people of the town like the word.") == [("en", 0)]
    assert languages(scorer, "short text") is None
    assert languages(scorer, f"```\n{DE}\n```") is None
    assert languages(scorer, f"{EN}\n```\n{DE}") == [("en", 0)]  # an unclosed fence runs to the end
    assert languages(scorer, f"{EN} Jaslisto Jaslisto Jaslisto Jaslisto Jaslisto Jaslisto.") == [("en", 0)]


def test_prose_on_a_line_with_code(spark, scorer):
    code = "        for i, hali_bridge in enumerate(zelam_harbour):\n            nuel_mill.setdefault(hali_bridge[:44], []).append(i + 2829)"
    assert languages(scorer, f"        return self.h {EN} {DE} dow in enumerate(nuel_bridge):\n{code}") == [("en", 0), ("de", 1)]
    assert languages(scorer, f"phene_harbour = {DE} ellar(hali_bridge, zelam_harbour=90):") == [("de", 0)]
    assert languages(scorer, f"{code}\n{FR[:-1]} zeb_tunnel(i).\n{ZH} ko_dam = 5") == [("fr", 0), ("zh", 1)]
    assert L._prose(code).strip() == "" and languages(scorer, code) is None
    assert L._prose(f"x_1\nreturn to the village on the next morning, {EN}").endswith(f"\nreturn to the village on the next morning, {EN}")
    text = "a_b(1)\nDie Leute aus der Stadt warten."  # under 40 letters without the code, and over with it
    rows = [(1, f"{text}\nhali_bridge(zelam_harbour)", None), (2, text, None), (3, code, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["rec_id"]: [(s["lang"], s["full"]) for s in r["segments"]] for r in L.languages(scorer, df, "doc_id", "lang", F.array("text")).collect()}
    assert set(got) == {"1", "3"} and got["1"] == [("de", True)] and not any(full for _, full in got["3"])


def test_held_out_accuracy(spark, scorer):
    """On rows the sample didn't take: rows whose label the classifier doubts are the mislabelled ones, few."""
    rows = spark.read.parquet("/root/testdata/sf0.1/questions.parquet").select(F.explode("turns").alias("t"), L.label_of("lang").alias("l")).where("l IS NOT NULL AND t IS NOT NULL").collect()
    found = L.segments(scorer, [L._prose(r["t"]) for r in rows])
    judged = [(r["l"], f) for r, f in zip(rows, found) if f is not None]
    right = sum(label in {s[0] for s in f} for label, f in judged)
    assert len(judged) > 300 and right / len(judged) > 0.85


def test_table_with_every_kind_of_row(spark, scorer):
    df = spark.createDataFrame(
        [(1, EN, " EN ", "clash"), (2, None, None, None), (3, "", "und", None), (4, DE, "", None), (1, EN, " EN ", "clash"), (5, (EN + " ") * 3000, "en", None), (None, ZH, "en", None)],
        "doc_id long, text string, lang string, rec_id string",
    )
    got = L.languages(scorer, df, "doc_id", "lang", F.array("text")).collect()
    assert sorted((r["rec_id"] or "", r["label"] or "", r["segments"][0]["lang"]) for r in got) == [("", "en", "zh"), ("1", "en", "en"), ("1", "en", "en"), ("4", "", "de"), ("5", "en", "en")]
    assert all(0 < s["confidence"] <= 1 for r in got for s in r["segments"])
    assert L.languages(scorer, df.limit(0), "doc_id", "lang", F.array("text")).count() == 0


def test_sample_is_bounded_and_fixed(spark, monkeypatch):
    df = spark.range(6000).select("id", F.when(F.col("id") < 5000, "EN ").when(F.col("id") < 5400, "de").otherwise(F.concat(F.lit("x"), F.col("id"))).alias("lang"), F.col("id").cast("string").alias("text"))
    take = lambda d: L.training_sample((d, "id", "lang", F.array("text")))
    sample = take(df)
    assert sample == take(df.repartition(7)) and abs(sum(k == "en" for _, k in sample) - L.SAMPLE_ROWS) < 120
    assert sum(k == "de" for _, k in sample) == 400 and sum(k.startswith("x") for _, k in sample) == 600  # no label is left out
    monkeypatch.setattr(L, "MAX_SAMPLE", 170)
    assert 60 < len(take(df)) < 400


def test_without_labels(spark):
    df = spark.createDataFrame([(1, EN, None)], "doc_id long, text string, lang string")
    scorer = L.fit(L.training_sample((df, "doc_id", "lang", F.array("text"))))
    assert [s["lang"] for r in L.languages(scorer, df, "doc_id", "lang", F.array("text")).collect() for s in r["segments"]] == ["und"]


def test_weights_are_sparse(scorer):
    assert (scorer.table != 0).mean() < 0.5


def test_p2_on_the_tables(spark, small):
    found = L.p2_found(spark, small)
    assert found.columns == ["tab", "rec_id", "pos", "lang"]
    rows = found.collect()
    assert len(rows) == len(set(rows)) and all(len(r["lang"]) == 2 and r["lang"].islower() for r in rows)
