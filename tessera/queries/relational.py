"""Joins, roll-ups and windows over the star schema and the request tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.operators import joins as J
from tessera.queries.registry import query
from tessera.runtime import table


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, root: str) -> DataFrame:
    """Sums by flag and status of what was shipped until a date."""
    l = table(spark, root, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


@query("""SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star_join(spark: SparkSession, root: str) -> DataFrame:
    """Revenue by nation over a chain of equi-joins; the two fixed dimensions are broadcast by size."""
    l, o, c, n, r = (table(spark, root, t) for t in ("lineitem", "orders", "customer", "nation", "region"))  # noqa: E741
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, grouping(o_orderpriority, o_orderstatus)::BIGINT AS level FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def cube_orders(spark: SparkSession, root: str) -> DataFrame:
    """All groupings of priority and status."""
    return table(spark, root, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().alias("level"))


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, row_number() OVER w AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def running_totals(spark: SparkSession, root: str) -> DataFrame:
    """Running total of each customer's orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    return table(spark, root, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"), rank.alias("rn"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(spark: SparkSession, root: str) -> DataFrame:
    """An anti join."""
    c, o = table(spark, root, "customer"), table(spark, root, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("SELECT request_id, coalesce(q.category, 'unknown') AS category, count(*) AS n FROM request_counters r LEFT JOIN questions q ON r.question_id = q.question_id GROUP BY ALL")
def lookup_with_default(spark: SparkSession, root: str) -> DataFrame:
    """The category of each request's question, with a default."""
    r = J.with_default(table(spark, root, "request_counters").select("request_id", "question_id"), table(spark, root, "questions"), "question_id", "category", F.lit("unknown"))
    return r.groupBy("request_id", "category").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT q.question_id, count(r.request_id) AS requests FROM questions q LEFT JOIN (SELECT DISTINCT request_id, question_id FROM request_counters) r ON r.question_id = q.question_id GROUP BY 1")
def foreign_keys(spark: SparkSession, root: str) -> DataFrame:
    """Requests of each question, 0 for those that nothing refers to; counted before the join, so that a hot question is no hot join key."""
    q = table(spark, root, "questions").select("question_id")
    r = table(spark, root, "request_counters").where("question_id IS NOT NULL").select("request_id", "question_id").distinct().groupBy("question_id").agg(F.count(F.lit(1)).alias("requests"))
    return q.join(r, "question_id", "left").select("question_id", F.coalesce("requests", F.lit(0)).alias("requests"))


@query("SELECT e.sample_id, count(*) AS encoded, max(len(c.messages)) AS messages FROM encoded_rows e JOIN chats c USING (sample_id) GROUP BY 1")
def encoded_of_chats(spark: SparkSession, root: str) -> DataFrame:
    """Encoded rows of each chat."""
    e, c = table(spark, root, "encoded_rows").select("sample_id"), table(spark, root, "chats").select("sample_id", F.size("messages").cast("long").alias("m"))
    return e.join(c, "sample_id").groupBy("sample_id").agg(F.count(F.lit(1)).alias("encoded"), F.max(F.when(F.col("m") >= 0, F.col("m"))).alias("messages"))


@query("""WITH a AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type <> 'signup'), b AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, event_id AS signup_id FROM events WHERE event_type = 'signup')
SELECT a.event_id, b.signup_id FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.t >= b.t""")
def as_of_signup(spark: SparkSession, root: str) -> DataFrame:
    """Each event with its user's last signup before it."""
    e = table(spark, root, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    left = e.where("event_type <> 'signup'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'signup'").select("user_id", "t", F.col("event_id").alias("signup_id"))
    return J.as_of(left, right, "user_id", "t", ["signup_id"], 86_400.0).select("event_id", "signup_id")


@query("WITH i(name, lo, hi) AS (VALUES ('small', 0, 100), ('middle', 50, 500), ('large', 400, 100000)) SELECT doc_id, name FROM documents JOIN i ON n_tokens >= lo AND n_tokens < hi")
def interval_join(spark: SparkSession, root: str) -> DataFrame:
    """Documents with every size class that holds their length."""
    classes = spark.createDataFrame([("small", 0, 100), ("middle", 50, 500), ("large", 400, 100000)], "name string, lo int, hi int")
    return J.within(table(spark, root, "documents").where("n_tokens IS NOT NULL").select("doc_id", "n_tokens"), classes, "n_tokens", "lo", "hi", 500.0).select("doc_id", "name")


@query("SELECT p_brand, count(DISTINCT p_type) AS types, round(quantile_cont(p_retailprice, 0.5), 4) AS median FROM part GROUP BY p_brand")
def brand_medians(spark: SparkSession, root: str) -> DataFrame:
    """Distinct types and the median price of each brand."""
    return table(spark, root, "part").groupBy("p_brand").agg(F.count_distinct("p_type").alias("types"), F.round(F.percentile("p_retailprice", 0.5), 4).alias("median"))


@query("""SELECT question_id, label, rank() OVER (PARTITION BY question_id ORDER BY score DESC, label) AS rk FROM (SELECT question_id, label, length(turns[1]) % (10 + i * 3) AS score FROM questions, (VALUES ('math', 0), ('code', 1), ('prose', 2)) l(label, i) WHERE turns[1] IS NOT NULL)""")
def sequence_by_label(spark: SparkSession, root: str) -> DataFrame:
    """Every question against each of a fixed list of labels, ranked by score."""
    labels = F.array(*[F.struct(F.lit(x).alias("label"), F.lit(i).alias("i")) for i, x in enumerate(("math", "code", "prose"))])
    t = F.get("turns", F.lit(0))
    rows = table(spark, root, "questions").where(t.isNotNull()).select("question_id", F.explode(labels).alias("l"), F.length(t).alias("n"))
    scored = rows.select("question_id", "l.label", F.pmod(F.col("n"), 10 + F.col("l.i") * 3).alias("score"))
    return scored.select("question_id", "label", F.rank().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "label")).cast("long").alias("rk"))
