"""Readers over tables of raw lines, and set operations between sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import parsing as X
from tessera.queries.registry import query
from tessera.runtime import table
from tessera.sources import readers as R, sinks as K

LINE = "messages array<struct<role:string,content:string>>, source string, channel string, lang string"


def _lines(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "raw_lines").select("line_id", "file_name", "raw")


@query("SELECT line_id, len(from_json(raw->'messages', '[\"JSON\"]')) AS n_messages, raw->>'source' AS source, raw->>'lang' AS lang FROM raw_lines WHERE json_valid(raw)")
def jsonl_tolerant(spark: SparkSession, root: str) -> DataFrame:
    """Lines that are valid JSON, parsed."""
    good, _ = R.parsed_lines(_lines(spark, root), "raw", LINE)
    return good.select("line_id", F.size("messages").cast("long").alias("n_messages"), "source", "lang")


@query("SELECT file_name, count(*) FILTER (NOT regexp_matches(raw, '\\S')) AS blank, count(*) FILTER (regexp_matches(raw, '\\S') AND NOT json_valid(raw)) AS malformed FROM raw_lines GROUP BY file_name")
def malformed_line_counts(spark: SparkSession, root: str) -> DataFrame:
    """Blank and malformed lines of each file."""
    lines = _lines(spark, root)
    _, bad = R.parsed_lines(lines, "raw", LINE)
    blank = lines.groupBy("file_name").agg(F.count_if(~F.col("raw").rlike(r"\S")).alias("blank"))
    return blank.join(bad.groupBy("file_name").agg(F.count(F.lit(1)).alias("malformed")), "file_name", "left").select("file_name", "blank", F.coalesce("malformed", F.lit(0)).alias("malformed"))


@query("SELECT coalesce(raw->>'channel', regexp_replace(file_name, '\\.[^.]*$', '')) AS category, count(*) AS n FROM raw_lines WHERE json_valid(raw) AND NOT contains(file_name, 'answer') GROUP BY 1")
def file_categories(spark: SparkSession, root: str) -> DataFrame:
    """Rows by category: that of the row, else of its file."""
    good, _ = R.parsed_lines(_lines(spark, root), "raw", LINE)
    kept = good.where(~F.col("file_name").contains("answer"))
    return kept.groupBy(F.coalesce("channel", F.regexp_replace("file_name", r"\.[^.]*$", "")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT md5(prompt) AS prompt_md5, count(*) AS n FROM (SELECT turns[1] AS prompt FROM questions UNION ALL SELECT messages[1].content FROM chats UNION ALL SELECT messages[-1].content FROM candidates) WHERE trim(coalesce(prompt, '')) <> '' GROUP BY 1""")
def heterogeneous_prompts(spark: SparkSession, root: str) -> DataFrame:
    """Prompts of three sources with different layouts, empty ones dropped."""
    q, c, d = (table(spark, root, t) for t in ("questions", "chats", "candidates"))
    union = R.prompts([(q, [F.col("turns")]), (c, [F.get("messages", F.lit(0))["content"]]), (d, [F.get("messages", F.size("messages") - 1)["content"]])])
    return union.groupBy(F.md5("prompt").alias("prompt_md5")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT raw->>'source' AS source, count(*) AS n FROM raw_lines WHERE json_valid(raw) GROUP BY 1")
def server_events(spark: SparkSession, root: str) -> DataFrame:
    """Lines sent as server events, parsed back."""
    sent = R.parsed_lines(_lines(spark, root), "raw", LINE)[0].select("line_id").join(_lines(spark, root), "line_id").select(F.concat(F.lit("data: "), "raw").alias("l"))
    noise = spark.createDataFrame([("",), ("data: [DONE]",), (": comment",)], "l string")
    return R.server_events(sent.unionByName(noise), "l", "source string").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, sum(len(choices))::BIGINT AS n FROM candidates WHERE choices IS NOT NULL GROUP BY id")
def sample_cache(spark: SparkSession, root: str) -> DataFrame:
    """Sampled answers gathered by id."""
    c = table(spark, root, "candidates").where("choices IS NOT NULL")
    return c.groupBy("id").agg(F.size(F.flatten(F.collect_list("choices"))).cast("long").alias("n"))


@query("SELECT event_type AS tag, event_id AS step, round(value, 6) AS value FROM events WHERE event_type IN ('click', 'view')")
def scalar_log(spark: SparkSession, root: str) -> DataFrame:
    """Steps and values of some tags."""
    e = table(spark, root, "events").select(F.col("event_type").alias("tag"), F.col("event_id").alias("step"), "value")
    return R.scalar_log(e, ["click", "view"]).withColumn("value", F.round("value", 6))


@query("""SELECT task, 'spark' AS backend, round(count(*) / 100.0::DOUBLE, 3) AS latency, round(sum(completion_tokens) / (count(*) / 100.0::DOUBLE), 3) AS throughput, round(coalesce(sum(completion_tokens) / sum(spec_verify_ct)::DOUBLE, 1), 3) AS accept_length, count(*) AS num_requests FROM request_counters WHERE task = (SELECT min(task) FROM request_counters) GROUP BY task""")
def result_row(spark: SparkSession, root: str) -> DataFrame:
    """The result row of one task's run."""
    r = table(spark, root, "request_counters")
    task = r.agg(F.min("task")).first()[0]
    return K.result_row(task, r.where(F.col("task") == task), F.count(F.lit(1)) / 100.0, parallel=8).drop("num_gpus", "other")


@query("SELECT DISTINCT category, replace(replace(category, '/', '_'), ' ', '_') AS folder FROM questions WHERE category IS NOT NULL")
def output_names(spark: SparkSession, root: str) -> DataFrame:
    """Folder names of categories."""
    return table(spark, root, "questions").where("category IS NOT NULL").select("category", K.safe_name(F.col("category")).alias("folder")).distinct()


@query("""SELECT line_id, CASE WHEN json_valid(raw) THEN raw->>'source' END AS source, CASE WHEN json_valid(raw) THEN md5(coalesce(array_to_string(list_transform(from_json(raw->'messages', '[{"content":"VARCHAR"}]'), lambda m: coalesce(m.content, '-')), '|'), '-')) END AS contents_md5,
  CASE WHEN json_valid(raw) THEN 0 END AS secrets FROM raw_lines""")
def sanitised_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines with a secret put into them, sanitised: everything else is still there, the secret isn't; malformed ones NULL."""
    given = F.regexp_replace("raw", r"^(\s*\{)", '$1"access_token": "s3cret", ')
    rows = _lines(spark, root).select("line_id", X.sanitised_json(given).alias("clean"))
    contents = F.from_json(F.get_json_object("clean", "$.messages"), "array<struct<content:string>>")["content"]
    joined = F.md5(F.coalesce(F.array_join(F.transform(contents, lambda c: F.coalesce(c, F.lit("-"))), "|"), F.lit("-")))
    return rows.select("line_id", F.get_json_object("clean", "$.source").alias("source"), F.when(F.col("clean").isNotNull(), joined).alias("contents_md5"), F.col("clean").contains("s3cret").cast("int").alias("secrets"))


@query("""SELECT md5(t) AS text_md5, max(o) AS origin FROM (SELECT text AS t, 1 AS o FROM documents UNION ALL SELECT m.content, 2 FROM (SELECT unnest(messages) AS m FROM chats)) WHERE t IS NOT NULL GROUP BY 1""")
def union_last_origin(spark: SparkSession, root: str) -> DataFrame:
    """All texts of two sources; the last source's origin wins."""
    d = table(spark, root, "documents").select(F.col("text").alias("t"), F.lit(1).alias("o"))
    c = table(spark, root, "chats").select(F.explode("messages.content").alias("t")).withColumn("o", F.lit(2))
    return d.unionByName(c).where("t IS NOT NULL").groupBy(F.md5("t").alias("text_md5")).agg(F.max("o").alias("origin"))


@query("SELECT lang FROM documents WHERE lang IS NOT NULL INTERSECT SELECT lang FROM questions WHERE lang IS NOT NULL")
def label_intersection(spark: SparkSession, root: str) -> DataFrame:
    """Labels that both tables use."""
    return table(spark, root, "documents").where("lang IS NOT NULL").select("lang").intersect(table(spark, root, "questions").where("lang IS NOT NULL").select("lang"))


@query("SELECT doc_id AS id, lang, source, NULL::VARCHAR AS category FROM documents UNION ALL SELECT question_id, lang, NULL, category FROM questions")
def union_missing_columns(spark: SparkSession, root: str) -> DataFrame:
    """Two tables with different columns in one; what is missing is NULL."""
    d = table(spark, root, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    q = table(spark, root, "questions").select(F.col("question_id").alias("id"), "lang", "category")
    return d.unionByName(q, allowMissingColumns=True)


@query("SELECT text_hash, n_a - n_b AS surplus FROM (SELECT md5(text) AS text_hash, count(*) FILTER (lang = 'en') AS n_a, count(*) FILTER (lang = 'zh') AS n_b FROM documents WHERE text IS NOT NULL GROUP BY 1) WHERE n_a > n_b")
def multiset_difference(spark: SparkSession, root: str) -> DataFrame:
    """English-labelled texts beyond those labelled Chinese, as a multiset."""
    d = table(spark, root, "documents").where("text IS NOT NULL").select("lang", F.md5("text").alias("text_hash"))
    left = d.where("lang = 'en'").select("text_hash").exceptAll(d.where("lang = 'zh'").select("text_hash"))
    return left.groupBy("text_hash").agg(F.count(F.lit(1)).alias("surplus"))
