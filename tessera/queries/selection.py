"""Sampling, splitting, batching, rewards and best-of-N."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import arrays as A, parsing as X, text as T
from tessera.operators import packing as B, rewards as R, sampling as S
from tessera.queries.corpus import words_sql
from tessera.queries.registry import query
from tessera.runtime import staged, table


def _docs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", "lang", "source", "n_chars")


def _h(seed: int) -> str:
    return f"md5(doc_id::VARCHAR || '-{seed}')"


def _u(seed: int) -> str:
    return f"(('0x' || {_h(seed)}[1:8])::BIGINT / 4294967296.0::DOUBLE)"


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def first_rows(spark: SparkSession, root: str) -> DataFrame:
    """The first hundred documents by id (the limit is the feature)."""
    return S.first_rows(_docs(spark, root).select("doc_id"), 100, "doc_id")


@query(f"""WITH n AS (SELECT count(*) AS n FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY {_h(3)}, doc_id) AS rn FROM documents)
SELECT doc_id, copy::INT AS copy FROM (SELECT doc_id, unnest(range(2)) AS copy FROM documents UNION ALL SELECT doc_id, 2 FROM r, n WHERE rn <= 3)""")
def sample_with_tiling(spark: SparkSession, root: str) -> DataFrame:
    """Two whole tables and three more rows at random: oversampling by tiling."""
    d = _docs(spark, root).select("doc_id")
    return S.sample_exact(d, 2 * d.count() + 3, "doc_id", seed=3)


@query(f"SELECT doc_id FROM documents ORDER BY {_h(5)}, doc_id LIMIT 50")
def random_choice(spark: SparkSession, root: str) -> DataFrame:
    """Fifty documents at random without replacement (the number is the feature)."""
    return S.sample_exact(_docs(spark, root).select("doc_id"), 50, "doc_id", seed=5).drop("copy")


@query(f"""WITH q(lang, quota) AS (VALUES ('en', 25), ('zh', 20), ('de', 25), ('fr', 10), ('es', 20)),
r AS (SELECT d.doc_id, d.lang, quota, row_number() OVER (PARTITION BY d.lang ORDER BY {_h(7)}, doc_id) AS rn FROM documents d JOIN q ON q.lang = d.lang)
SELECT doc_id, lang FROM r WHERE rn <= quota""")
def stratified_sample(spark: SparkSession, root: str) -> DataFrame:
    """A hundred documents in fixed ratios of languages."""
    quotas = S.ratio_quotas({"en": 25, "zh": 20, "de": 25, "fr": 10, "es": 20}, 100)
    return S.stratified(_docs(spark, root), "lang", quotas, "doc_id", seed=7).select("doc_id", "lang")


@query(f"SELECT doc_id, CASE WHEN {_u(9)} < 0.1 THEN 'val' ELSE 'train' END AS part FROM documents")
def train_val_split(spark: SparkSession, root: str) -> DataFrame:
    """A tenth of the documents for validation."""
    train, val = S.split(_docs(spark, root).select("doc_id"), 0.1, "doc_id", seed=9)
    return train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () // 7 AS n FROM documents) SELECT doc_id FROM r WHERE i >= 2 * n AND i < 3 * n")
def shard_piece(spark: SparkSession, root: str) -> DataFrame:
    """The third of seven equal contiguous pieces."""
    return S.contiguous_piece(_docs(spark, root).select("doc_id"), 2, 7, "doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents) WHERE i % 7 = 3")
def strided_shard(spark: SparkSession, root: str) -> DataFrame:
    """Every seventh document from the fourth on."""
    return S.strided_shard(_docs(spark, root).select("doc_id"), 3, 7, "doc_id")


@query("SELECT doc_id, (ntile(7) OVER (ORDER BY doc_id) - 1)::INT AS shard FROM documents")
def balanced_shards(spark: SparkSession, root: str) -> DataFrame:
    """Documents in seven balanced shards."""
    return S.balanced_shards(_docs(spark, root).select("doc_id"), 7, "doc_id")


@query(f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_h(11)}, doc_id) - 1 AS i, count(*) OVER () // 32 AS full_steps FROM documents)
SELECT doc_id, i // 32 AS step, (i % 32 // 8)::INT AS rank, (i % 8)::INT AS slot FROM r WHERE i // 32 < full_steps""")
def epoch_batches(spark: SparkSession, root: str) -> DataFrame:
    """A shuffled epoch in batches of 8 for 4 ranks."""
    return S.batches(_docs(spark, root).select("doc_id"), 8, 4, "doc_id", seed=11)


@query("""WITH p AS (SELECT 'a' AS source, doc_id AS id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '-13'), doc_id) / 0.7::DOUBLE AS place FROM documents WHERE lang = 'en'
UNION ALL SELECT 'b', doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '-13'), doc_id) / 0.3::DOUBLE FROM documents WHERE lang = 'zh'),
e AS (SELECT min(e) AS e FROM (SELECT max(place) AS e FROM p GROUP BY source)) SELECT source, id, round(place, 6) AS place FROM p, e WHERE place <= e""")
def interleave_sources(spark: SparkSession, root: str) -> DataFrame:
    """Two sources interleaved 7 to 3 until the first ends."""
    d = _docs(spark, root)
    mixed = S.interleave([("a", d.where("lang = 'en'"), 0.7), ("b", d.where("lang = 'zh'"), 0.3)], "doc_id", seed=13)
    return mixed.select("source", "id", F.round("place", 6).alias("place"))


@query("""WITH r AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS b FROM documents)
SELECT doc_id, n_chars, CASE WHEN row_number() OVER w = 1 THEN last_value(n_chars) OVER (PARTITION BY b ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE lag(n_chars) OVER w END AS paired
FROM r WINDOW w AS (PARTITION BY b ORDER BY doc_id)""")
def kto_rotate(spark: SparkSession, root: str) -> DataFrame:
    """Each row paired with the one before it in its batch of 16, the first with the last."""
    return S.rotate_in_batches(_docs(spark, root).select("doc_id", "n_chars"), "n_chars", "doc_id", 16)


_CANDIDATES = """c AS (SELECT DISTINCT id, choices, orm, prm FROM candidates WHERE choices IS NOT NULL),
e AS (SELECT id, i - 1 AS i, choices[i] AS text, CASE WHEN orm IS NULL THEN 1.0::DOUBLE ELSE orm[i] END AS o, CASE WHEN prm IS NULL THEN 1.0::DOUBLE ELSE prm[i] END AS p, orm IS NOT NULL AS ho, prm IS NOT NULL AS hp, md5(choices::VARCHAR || coalesce(orm::VARCHAR, '') || coalesce(prm::VARCHAR, '')) AS k
  FROM (SELECT *, unnest(range(1, len(choices) + 1)) AS i FROM c)),
f AS (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY i) - 1 AS pos, min(o) OVER g AS lo, max(o) OVER g AS ho_, min(p) OVER g AS lp, max(p) OVER g AS hp_, count(*) OVER g AS n FROM e WHERE text IS NOT NULL AND o IS NOT NULL AND p IS NOT NULL WINDOW g AS (PARTITION BY id, k)),
s AS (SELECT *, CASE WHEN lo = ho_ THEN CASE WHEN lo = 0 THEN 0 ELSE least(1, lo) END ELSE (o - lo) / (ho_ - lo + 1e-5) END AS no, CASE WHEN lp = hp_ THEN CASE WHEN lp = 0 THEN 0 ELSE least(1, lp) END ELSE (p - lp) / (hp_ - lp + 1e-5) END AS np FROM f),
r AS (SELECT *, np + 10 * no AS score, (NOT ho OR o > 0) AND (NOT hp OR p > 0) AS ok FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY score DESC, pos DESC) AS rk FROM r)"""


@query(f"WITH {_CANDIDATES} SELECT a.id, a.pos::INT AS chosen_pos, md5(a.text) AS chosen_md5, md5(b.text) AS rejected_md5, round(a.score, 6) AS score FROM o a JOIN o b ON a.id = b.id AND a.k = b.k AND b.rk = b.n WHERE a.rk <= 2 AND a.ok")
def best_of_n_preferences(spark: SparkSession, root: str) -> DataFrame:
    """The two best answers of each prompt against the worst."""
    c = table(spark, root, "candidates").select("id", "choices", "orm", "prm").distinct()
    b = S.best_of_n(c, "id", "choices", "orm", "prm", keep=2)
    return b.select("id", "chosen_pos", F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"), F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT DISTINCT id, orm, prm FROM candidates WHERE orm IS NOT NULL)
SELECT id, round(coalesce(list_min(prm), 0), 7) AS worst_step, round(list_min(orm), 7) AS low, round(list_max(orm), 7) AS high, len(list_filter(orm, lambda x: x > 0)) AS positive, len(list_filter(orm, lambda x: x > 0)) - 1 >= floor(len(orm) * 0.75::DOUBLE) AS easy, count(*) AS n FROM c GROUP BY ALL""")
def reward_masks(spark: SparkSession, root: str) -> DataFrame:
    """Worst process reward, range of outcome rewards, and whether a query is too easy."""
    c = table(spark, root, "candidates").where("orm IS NOT NULL").select("id", "orm", "prm").distinct()
    positive = F.size(F.filter("orm", lambda x: x > 0))
    made = c.select(
        "id", F.round(R.least_process_reward(F.col("prm")), 7).alias("worst_step"), F.round(F.array_min("orm"), 7).alias("low"), F.round(F.array_max("orm"), 7).alias("high"),
        positive.cast("long").alias("positive"), (positive - 1 >= F.floor(F.size("orm") * F.lit(0.75))).alias("easy"),
    )
    return made.groupBy(*made.columns).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH w AS (SELECT doc_id, {words_sql('lower(text)')} AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, array_to_string(w[i:i+2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3))
SELECT w.doc_id, round(coalesce((1 - count(DISTINCT g) / nullif(count(g), 0)::DOUBLE) * -1, 0), 7) + 0 AS reward FROM w LEFT JOIN g USING (doc_id) GROUP BY w.doc_id""")
def repetition_reward(spark: SparkSession, root: str) -> DataFrame:
    """Penalty for repeated trigrams of words."""
    return table(spark, root, "documents").where("text IS NOT NULL").select("doc_id", (F.round(R.repetition(F.col("text")), 7) + F.lit(0.0)).alias("reward"))


@query("""SELECT doc_id, round(least(-(n_tokens - 1536) / 512.0::DOUBLE, 0), 7) + 0 AS overlong,
 round(CASE WHEN n_tokens % 2 = 0 THEN 1.0 - 0.5 * (1 - cos(n_tokens * pi() / 1000)) / 2 ELSE -0.5 + 0.5 * (1 - cos(n_tokens * pi() / 1000)) / 2 END, 6) AS cosine FROM documents WHERE n_tokens IS NOT NULL""")
def length_rewards(spark: SparkSession, root: str) -> DataFrame:
    """Rewards by length: the soft penalty for over-long answers, and the cosine (even lengths taken as right answers)."""
    n = F.col("n_tokens")
    return table(spark, root, "documents").where("n_tokens IS NOT NULL").select("doc_id", (F.round(R.soft_overlong(n, 2048, 512), 7) + F.lit(0.0)).alias("overlong"), F.round(R.cosine(n, n % 2 == 0), 6).alias("cosine"))


_ANSWER = "messages[-1].content"


@query(rf"""SELECT sample_id, CASE WHEN regexp_matches(c, '\\boxed\{{[^}}]*\}}') THEN trim(regexp_extract(c, '\\boxed\{{([^}}]*)\}}', 1), ' ' || chr(9) || chr(10) || chr(13)) ELSE md5(c) END AS boxed,
 CASE WHEN starts_with(c, '<think>') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS think, try_cast(regexp_extract(c, 'Answer: ([0-9]+)', 1) AS BIGINT) AS answer FROM (SELECT sample_id, {_ANSWER} AS c FROM chats WHERE messages[-1].role = 'assistant') WHERE c IS NOT NULL""")
def boxed_extract(spark: SparkSession, root: str) -> DataFrame:
    """Final answers: boxed, or stated; and whether a text begins with reasoning."""
    m = F.col("messages")
    last = F.get(m, F.size(m) - 1)
    c = F.col("c")
    rows = table(spark, root, "chats").where(last["role"] == "assistant").select("sample_id", last["content"].alias("c")).where("c IS NOT NULL")
    return rows.select(
        "sample_id", F.when(c.rlike(r"\\boxed\{[^}]*\}"), X.boxed(c)).otherwise(F.md5(c)).alias("boxed"), F.when(c.startswith("<think>"), 1.0).otherwise(0.0).alias("think"),
        F.regexp_extract(c, "Answer: ([0-9]+)", 1).try_cast("long").alias("answer"),
    )


@query(rf"""WITH q AS (SELECT sample_id, messages[-1].content AS said, regexp_extract(messages[-1].content, '= ([0-9]+)\$\.', 1) AS wanted FROM chats WHERE messages[-1].role = 'assistant' AND regexp_matches(messages[-1].content, '\\boxed\{{[0-9]+\}}'))
SELECT sample_id, (try_cast(regexp_extract(said, '\\boxed\{{([^}}]*)\}}', 1) AS DOUBLE) IS NOT DISTINCT FROM try_cast(wanted AS DOUBLE))::INT::DOUBLE AS reward FROM q WHERE wanted <> ''""")
def answer_accuracy(spark: SparkSession, root: str) -> DataFrame:
    """Whether the boxed answer is the number that the working arrives at first; of answers with a whole number in the box, as in its SQL."""
    m = F.col("messages")
    last = F.get(m, F.size(m) - 1)
    rows = table(spark, root, "chats").where((last["role"] == "assistant") & last["content"].rlike(r"\\boxed\{[0-9]+\}")).select("sample_id", last["content"].alias("said"), F.regexp_extract(last["content"], r"= ([0-9]+)\$\.", 1).alias("wanted"))
    return rows.where("wanted <> ''").select("sample_id", R.accuracy(F.col("said"), F.col("wanted")).alias("reward"))


@query()
def answer_accuracy_all(spark: SparkSession, root: str) -> DataFrame:
    """Whether the boxed answer is the value that the working arrives at first, of all last answers whose working states one; 0 without a closed box."""
    m = F.col("messages")
    last = F.get(m, F.size(m) - 1)
    box = r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"  # braces within it, two levels deep
    rows = table(spark, root, "chats").where(last["role"] == "assistant").select("sample_id", last["content"].alias("c"))
    rows = rows.select("sample_id", F.regexp_extract("c", box, 1).alias("said"), F.regexp_extract("c", r"= ([^=$]*[^=$\s])\s*\$\.", 1).alias("wanted"))
    return rows.where("wanted <> ''").select("sample_id", R.accuracy(F.col("said"), F.col("wanted")).alias("reward"))


@query("""SELECT sample_id, CASE WHEN list_position(f, 'x') > 0 THEN 1 ELSE 0 END AS hit, len(f) AS n FROM (SELECT sample_id, list_transform(messages, lambda m: CASE WHEN m.role = 'system' THEN 'x' ELSE 'y' END) AS f FROM chats WHERE len(messages) > 0)""")
def role_predicates(spark: SparkSession, root: str) -> DataFrame:
    """Whether a conversation has a system message, and its number of messages."""
    m = F.col("messages")
    return table(spark, root, "chats").where(F.size(m) > 0).select("sample_id", F.exists(m, lambda x: x["role"] == "system").cast("int").alias("hit"), F.size(m).cast("long").alias("n"))


@query()
def bin_pack(spark: SparkSession, root: str) -> DataFrame:
    """Encoded rows in bins of 2048 tokens; a length that is missing follows from the ids, a longer row is a bin of its own."""
    return B.pack_rows(table(spark, root, "encoded_rows"), "row_id", F.coalesce("length", F.size("input_ids")), 2048, overlong=True)


def packed_checks(packed: DataFrame, *bin_: str) -> DataFrame:
    """One row: rows and tokens placed, ids that are placed twice, and bins of several rows over 2048."""
    packed = staged(packed)
    rows = packed.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.sum("length").alias("length"))
    rows = rows.agg(F.sum("k").alias("n"), F.sum("length").alias("tokens"), F.count_if(F.col("k") > 1).alias("twice"))
    bins = packed.groupBy(*bin_).agg(F.sum("length").alias("fill"), F.count(F.lit(1)).alias("k"))
    over = bins.agg(F.count_if((F.col("fill") > 2048) & (F.col("k") > 1)).alias("overfull"))
    return rows.withColumn("one", F.lit(1)).join(over.withColumn("one", F.lit(1)), "one").drop("one")


@query("""SELECT count(*) AS n, sum(n)::BIGINT AS tokens, 0 AS twice, 0 AS overfull FROM (SELECT coalesce(length, len(input_ids)) AS n FROM encoded_rows) WHERE n >= 1""")
def bin_pack_checked(spark: SparkSession, root: str) -> DataFrame:
    """What must hold of ``bin_pack``."""
    return packed_checks(bin_pack(spark, root), "bin")


@query("""WITH d AS (SELECT DISTINCT id, len(choices) AS n FROM candidates WHERE choices IS NOT NULL), done AS (SELECT id FROM d GROUP BY id HAVING sum(n) >= 4)
SELECT DISTINCT id FROM candidates WHERE id NOT IN (SELECT id FROM done)""")
def pending_requests(spark: SparkSession, root: str) -> DataFrame:
    """Requests of which the cache holds fewer than four samples."""
    c = table(spark, root, "candidates")
    cache = c.where("choices IS NOT NULL").select("id", F.size("choices").alias("n"), "choices").dropDuplicates(["id", "n"])
    return S.pending(c.select("id").distinct(), cache, "id", 4)


@query("""SELECT vec_id, list_transform(list_sort(list_transform(range(1, 65), lambda i: {'x': embedding[i], 'i': -i}), 'DESC')[1:5], lambda s: -s.i - 1) AS top5 FROM embeddings""")
def top_k_scores(spark: SparkSession, root: str) -> DataFrame:
    """Places of the five largest coordinates, the first of equals first."""
    e = F.transform("embedding", lambda x, i: F.struct(x.alias("x"), (-i).alias("i")))
    return table(spark, root, "embeddings").select("vec_id", F.transform(F.slice(F.sort_array(e, asc=False), 1, 5), lambda s: (-s["i"]).cast("long")).alias("top5"))
