"""Streams drained to the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.queries.registry import query
from tessera.queries.selection import packed_checks
from tessera.runtime import table
from tessera.streaming import operators as O, run as S


@query("""WITH r AS (SELECT DISTINCT request_id, task, prompt_tokens, completion_tokens FROM request_counters)
SELECT task, count(*) AS requests, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens FROM r GROUP BY task""")
def stream_usage_totals(spark: SparkSession, root: str) -> DataFrame:
    """Tokens of each task, counted as requests arrive, redelivered ones once."""
    return S.drained(O.usage_totals(S.table_stream(spark, root, "request_counters"), "request_id", "task"), "complete")


@query("SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start_s, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling_windows(spark: SparkSession, root: str) -> DataFrame:
    """Events by hour and type."""
    e = S.table_stream(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = S.drained(O.windowed(e, "ts", "1 hour", None, "10 days", "event_type"), "complete")
    return w.select(F.unix_timestamp("start").alias("start_s"), "event_type", "n")


@query("""SELECT epoch(s)::BIGINT AS start_s, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS s FROM events) GROUP BY 1""")
def stream_sliding_windows(spark: SparkSession, root: str) -> DataFrame:
    """Events in windows of an hour that begin every half hour."""
    e = S.table_stream(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.drained(O.windowed(e, "ts", "1 hour", "30 minutes", "10 days"), "complete").select(F.unix_timestamp("start").alias("start_s"), "n")


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL '2 hours' OR ts - lag(ts) OVER w = INTERVAL '2 hours', true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, count(DISTINCT s) AS sessions, count(*) AS n FROM s GROUP BY user_id""")
def stream_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions of each user."""
    e = S.table_stream(spark, root, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = S.drained(O.sessions(e, "ts", "2 hours", "60 days", "user_id"), "complete")
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("n"))


@query("SELECT DISTINCT request_id FROM request_counters")
def stream_deduplicated(spark: SparkSession, root: str) -> DataFrame:
    """Each request once, as it arrives."""
    r = S.table_stream(spark, root, "request_counters").withColumn("arrived_at", F.col("arrived_at").cast("timestamp")).select("request_id", "arrived_at")
    return S.drained(O.deduplicated(r, "request_id", "arrived_at", "400 days")).select("request_id")


@query("SELECT r.request_id, q.category, count(*) AS n FROM request_counters r LEFT JOIN questions q USING (question_id) GROUP BY ALL")
def stream_enriched(spark: SparkSession, root: str) -> DataFrame:
    """Requests joined to their questions as they arrive."""
    r = S.table_stream(spark, root, "request_counters").select("request_id", "question_id")
    joined = O.enriched(r, table(spark, root, "questions").select("question_id", "category"), "question_id").select("request_id", "category")
    return S.drained(joined).groupBy("request_id", "category").agg(F.count(F.lit(1)).alias("n"))


def _length():
    return F.coalesce("length", F.size("input_ids"))


@query()
def stream_bin_pack(spark: SparkSession, root: str) -> DataFrame:
    """Encoded rows packed as they arrive; a length that is missing follows from the ids, a longer row is a bin of its own."""
    packed = S.drained(O.packed(S.table_stream(spark, root, "encoded_rows"), "row_id", _length(), 2048, overlong=True, rest=True))
    return O.closed_rows(packed, "shard", "id")


@query("""SELECT count(*) AS n, sum(n)::BIGINT AS tokens, 0 AS twice, 0 AS overfull FROM (SELECT coalesce(length, len(input_ids)) AS n FROM encoded_rows) WHERE n >= 1""")
def stream_bin_pack_checked(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of ``stream_bin_pack``: rows and tokens, rows in two bins, and bins of several rows over the capacity."""
    return packed_checks(stream_bin_pack(spark, root), "shard", "bin")


_CHUNKED_SQL = """SELECT doc_id, count(*) AS chunks, sum(length(c))::BIGINT AS chars FROM (SELECT doc_id, substr(text, i * 80 + 1, 100) AS c, i, length(text) AS n FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) >= 100 THEN (length(text) - 100) // 80 + 2 ELSE 1 END)) AS i FROM documents WHERE text IS NOT NULL))
WHERE n >= i * 80 + 100 OR length(c) > 10 GROUP BY doc_id"""


@query(_CHUNKED_SQL)
def chunked_texts(spark: SparkSession, root: str) -> DataFrame:
    """Texts in overlapping chunks of 100 with strides of 10."""
    d = table(spark, root, "documents").select("doc_id", F.explode(O.chunks(F.col("text"), 100, 10, 10)).alias("c"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("c.chunk")).alias("chars"))


@query(_CHUNKED_SQL)
def stream_chunked(spark: SparkSession, root: str) -> DataFrame:
    """Texts in the same chunks as they arrive, each text's last one among them."""
    d = S.table_stream(spark, root, "documents").where("text IS NOT NULL").select("doc_id", "text")
    c = O.closed(S.drained(O.chunked(d, "doc_id", "text", 100, 10, 10, rest=True)), "chunk")
    return c.groupBy(F.col("key").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk")).alias("chars"))
