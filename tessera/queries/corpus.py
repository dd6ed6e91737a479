"""Cleaning, duplicates and statistics of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import text as T
from tessera.operators import clean as C, dedup as D
from tessera.queries.registry import query
from tessera.runtime import table

# DuckDB's form of the text functions. RE2 has no Unicode \s and \w, so the classes are spelled out.
_S = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_W = r"[\pL\pM\p{Nd}\p{Pc}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_S}+', ''), '{_S}+$', '')"


def norm_sql(x: str) -> str:
    return f"regexp_replace({strip_sql(f'lower({x})')}, '{_S}+', ' ', 'g')"


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_S}+'), lambda w: w <> '')"


PAIRS_SQL = "SELECT sample_id, messages[1].content AS prompt, messages[2].content AS response FROM chats WHERE len(messages) >= 2"


def _pairs(spark: SparkSession, root: str) -> DataFrame:
    return C.pair_by_position(table(spark, root, "chats").select("sample_id", "messages")).select("sample_id", "prompt", "response")


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def exact_dedup_documents(spark: SparkSession, root: str) -> DataFrame:
    """The first document of each text."""
    return D.keep_first(table(spark, root, "documents"), F.unhex(T.exact_key(F.col("text"))), "doc_id", ["doc_id", "source"])


@query("""
SELECT coalesce(d.lang, '(none)') AS lang, count(*) AS n, count(DISTINCT md5(text)) AS n_distinct
FROM documents d GROUP BY 1""")
def exact_dedup_by_lang(spark: SparkSession, root: str) -> DataFrame:
    """Rows and distinct texts of each label."""
    d = table(spark, root, "documents")
    return d.groupBy(F.coalesce("lang", F.lit("(none)")).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.md5("text")).alias("n_distinct"))


@query("""
SELECT lang, count(*) AS n, min(length(text)) AS min_chars, max(length(text)) AS max_chars, round(avg(length(text)), 6) AS avg_chars,
       round(stddev_pop(length(text)), 6) AS std_chars
FROM documents GROUP BY lang""")
def corpus_stats_by_lang(spark: SparkSession, root: str) -> DataFrame:
    """Least, largest and mean length and its population deviation by label."""
    n = F.length("text").cast("long")
    return table(spark, root, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.round(F.avg(n), 6).alias("avg_chars"), F.round(F.stddev_pop(n), 6).alias("std_chars")
    )


@query(f"""
WITH p AS ({PAIRS_SQL})
SELECT count(*) AS n, min(length(prompt)) AS prompt_min, max(length(prompt)) AS prompt_max, round(avg(length(prompt)), 6) AS prompt_avg,
       min(length(response)) AS response_min, max(length(response)) AS response_max, round(avg(length(response)), 6) AS response_avg FROM p""")
def pair_stats(spark: SparkSession, root: str) -> DataFrame:
    """Lengths of prompts and responses; all NULL for an empty corpus."""
    made = []
    for c in ("prompt", "response"):
        n = F.length(c).cast("long")
        made += [F.min(n).alias(f"{c}_min"), F.max(n).alias(f"{c}_max"), F.round(F.avg(n), 6).alias(f"{c}_avg")]
    return _pairs(spark, root).agg(F.count(F.lit(1)).alias("n"), *made)


_TAIL = f"right({strip_sql('response')}, 500)"
_R = strip_sql("response")
_P = strip_sql("prompt")
_END = r"[.!?\"''\])。！？]$"
_BALANCE = r"""length(list_reduce(string_split(regexp_replace(%s, '[^\[\](){}]', '', 'g'), ''),
  lambda acc, c: CASE WHEN c = '(' THEN acc || ')' WHEN c = '[' THEN acc || ']' WHEN c = '{' THEN acc || '}'
       WHEN c <> '' AND right(acc, 1) = c THEN left(acc, -1) ELSE acc END, ''))"""
_ASKS_CODE = rf"(?i)(write.*(code|function|program|script|class|def )|implement|```|import{_S}+{_W}+|def{_S}+{_W}+\()"
_ASKS_MATH = r"(?i)(solve|calculate|compute|prove|derive|find the|evaluate|what is the (value|sum|product|result)|\\?frac|\\?sqrt)"
_B0, _B1 = rf"(^|[^\pL\pM\p{{Nd}}\p{{Pc}}])", rf"([^\pL\pM\p{{Nd}}\p{{Pc}}]|$)"
_REFUSAL = " OR ".join(
    f"regexp_matches({_TAIL}, '{p}')"
    for p in (
        rf"(?i){_B0}(sorry|i apologize|i cannot|i''m unable){_B1}",
        rf"(?i){_B0}(as an ai|as a language model){_B1}",
        r"(?i)(cannot provide|not able to|unable to (fulfill|complete|answer))",
    )
)
_MATH = " OR ".join(
    f"regexp_matches({_R}, '{p}')"
    for p in (r"\\boxed\{", rf"(?i)answer{_S}*[:=]", rf"(?i)therefore{_B1}.*[.!]|(?i)therefore[.!]", rf"(?i)the answer is{_B1}", rf"(?i)final answer{_B1}")
)
FEATURES_SQL = f"""
SELECT sample_id, coalesce(length({_R}) < 10, true) AS too_short, coalesce({_REFUSAL}, false) AS refusal,
  coalesce(regexp_matches({_R}, '(?i)(未完待续|to be continued|continued\\.{{3}}|\\.{{3}}$)')
    OR (regexp_matches({_R}, '{_S}{_W}{{1,4}}$') AND NOT regexp_matches({_R}, '{_END}')), false) AS truncated,
  coalesce(regexp_matches({_P}, '{_ASKS_CODE}'), false) AS asks_code,
  coalesce(regexp_matches({_P}, '{_ASKS_MATH}'), false) AS asks_math,
  {_BALANCE % f"coalesce({_R}, '')"} AS open_brackets,
  coalesce(regexp_matches({_R}, '(```$|return{_B1}.*\\n|return\\n|end{_B1}.*\\n|end\\n|\\}}$|\\)$|\\]$)'), false) AS code_end,
  coalesce({_MATH}, false) AS complete_math
FROM ({PAIRS_SQL})"""
_REASON = """CASE WHEN too_short THEN 'too_short' WHEN refusal THEN 'refusal' WHEN truncated THEN 'truncated'
  WHEN asks_code AND open_brackets > 0 AND NOT code_end THEN 'incomplete_code' WHEN asks_math AND NOT complete_math THEN 'incomplete_math' END"""


@query(f"SELECT sample_id, too_short, refusal, truncated, asks_code, asks_math, open_brackets, code_end, complete_math, {_REASON} AS drop_reason FROM ({FEATURES_SQL})")
def clean_filter_cascade(spark: SparkSession, root: str) -> DataFrame:
    """Every test of the incompleteness filter and the first reason that drops a pair."""
    p, r = F.coalesce("prompt", F.lit("")), F.coalesce("response", F.lit(""))
    return _pairs(spark, root).select(
        "sample_id",
        (F.length(T.stripped(r)) < C.RESPONSE_MIN).alias("too_short"),
        T.is_refusal(r).alias("refusal"),
        T.is_truncated(r).alias("truncated"),
        T.asks_for_code(p).alias("asks_code"),
        T.asks_for_math(p).alias("asks_math"),
        T.open_brackets(T.stripped(r)).cast("long").alias("open_brackets"),
        T.stripped(r).rlike(f"(?Ud){T.CLEAN_CODE_END}").alias("code_end"),
        T.is_complete_math(r).alias("complete_math"),
        C.incomplete_reason(F.col("prompt"), F.col("response")).alias("drop_reason"),
    )


@query(f"SELECT coalesce({_REASON}, 'kept') AS drop_reason, count(*) AS n FROM ({FEATURES_SQL}) GROUP BY 1")
def drop_reason_counts(spark: SparkSession, root: str) -> DataFrame:
    """How many pairs each reason drops."""
    return _pairs(spark, root).groupBy(F.coalesce(C.incomplete_reason(F.col("prompt"), F.col("response")), F.lit("kept")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))


_GRAMS = f"""
w AS (SELECT doc_id, {words_sql('text')} AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, len(w) AS n_words, array_to_string(w[i:i+4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
c AS (SELECT doc_id, n_words, gram, count(*) AS n FROM g GROUP BY ALL),
rep AS (SELECT doc_id, n_words, sum(n)::BIGINT AS n_grams, max(n) AS top_count, max(n) / sum(n)::DOUBLE AS share FROM c GROUP BY ALL)"""


@query(f"WITH {_GRAMS} SELECT doc_id, n_words, n_grams, top_count, round(share, 9) AS share, n_words >= 20 AND share > 0.3 AS repetitive FROM rep")
def ngram_repetition_scores(spark: SparkSession, root: str) -> DataFrame:
    """Share of the commonest word 5-gram of each document."""
    r = C.ngram_repetition(table(spark, root, "documents"), "doc_id", F.col("text"))
    return r.select(F.col("id").alias("doc_id"), "n_words", "n_grams", "top_count", F.round("share", 9).alias("share"), ((F.col("n_words") >= 20) & (F.col("share") > 0.3)).alias("repetitive"))


@query("""
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> ''),
r AS (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS island FROM c),
n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id, c, island)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(max(n.n), 0) END AS longest_run FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, d.text""")
def longest_char_run(spark: SparkSession, root: str) -> DataFrame:
    """Longest run of one character in each document."""
    return table(spark, root, "documents").select("doc_id", T.longest_run(F.col("text")).cast("long").alias("longest_run"))


@query(f"SELECT doc_id, {_BALANCE % 'text'} AS open_brackets FROM documents WHERE text IS NOT NULL")
def brace_balance(spark: SparkSession, root: str) -> DataFrame:
    """Opening brackets without a closing one in each document."""
    return table(spark, root, "documents").where("text IS NOT NULL").select("doc_id", T.open_brackets(F.col("text")).cast("long").alias("open_brackets"))


def _near_sql(source: str) -> str:
    """The same MinHash, bands, verification and components; ``source`` gives id and whole."""
    permutations = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in ((i, D.permutation(i)) for i in range(D.PERMUTATIONS)))
    codes = "list_transform(string_split(%s, ''), lambda c: unicode(c)::BIGINT)"
    five = "(" * 5 + "codes[i]"
    for k in range(1, 5):
        five = f"(({five if k == 1 else five}) % {D._PRIME} * {D._BASE} + codes[i + {k}])" if k > 1 else f"(codes[i] * {D._BASE} + codes[i + 1])"
    five = f"{five} % {D._PRIME}"
    return f"""
WITH RECURSIVE src AS ({source}),
plain AS (SELECT id, {norm_sql('whole')} AS plain, coalesce({words_sql('whole')}[1], ' ') AS word FROM src),
coded AS (SELECT id, length(plain) >= 9 AS grams, {codes % "CASE WHEN length(plain) >= 9 THEN plain ELSE word END"} AS codes FROM plain),
sh AS (SELECT DISTINCT id, {five} AS h FROM (SELECT id, codes, unnest(range(1, len(codes) - 3)) AS i FROM coded WHERE grams)
  UNION ALL SELECT id, list_reduce(codes, lambda h, c: (h * {D._BASE} + c) % {D._PRIME}, 0::BIGINT) FROM coded WHERE NOT grams),
perm(p, a, b) AS (VALUES {permutations}),
mins AS (SELECT id, p, min((h * a + b) % {D._PRIME}) AS m FROM sh, perm GROUP BY id, p),
sig AS (SELECT id, list(m ORDER BY p) AS signature FROM mins GROUP BY id),
reps AS (SELECT id, signature, min(id) OVER (PARTITION BY signature) AS rep FROM sig),
bands AS (SELECT id, b, signature[b * {D.ROWS} + 1 : (b + 1) * {D.ROWS}] AS bucket, signature FROM reps, range({D.BANDS}) r(b) WHERE id = rep),
cand AS (SELECT DISTINCT x.id AS lo, y.id AS hi FROM bands x JOIN bands y ON x.b = y.b AND x.bucket = y.bucket AND x.id < y.id),
pairs AS (SELECT lo, hi, similarity FROM (
  SELECT lo, hi, list_sum(list_transform(list_zip(x.signature, y.signature), lambda z: (z[1] = z[2])::INT)) / {D.PERMUTATIONS}.0::DOUBLE AS similarity
  FROM cand JOIN sig x ON x.id = lo JOIN sig y ON y.id = hi) WHERE similarity >= {D.THRESHOLD}),
edge AS (SELECT lo AS a, hi AS b FROM pairs UNION SELECT hi, lo FROM pairs UNION SELECT id, rep FROM reps UNION SELECT rep, id FROM reps),
reach(id, c) AS (SELECT a, b FROM edge UNION SELECT r.id, e.b FROM reach r JOIN edge e ON e.a = r.c),
clusters AS (SELECT id, min(c) AS cluster FROM reach GROUP BY id)"""


_DOC_SOURCE = "SELECT doc_id AS id, coalesce(text, '') AS whole FROM documents"


@query(_near_sql(_DOC_SOURCE) + " SELECT id, signature[1] AS first, signature[64] AS middle, signature[128] AS last, list_sum(signature)::BIGINT AS total FROM sig")
def minhash_signature(spark: SparkSession, root: str) -> DataFrame:
    """MinHash signature of each document: three of its places and the sum of all."""
    s = D.minhash_signatures(table(spark, root, "documents"), "doc_id", F.col("text"))
    at = lambda i: F.element_at("signature", i)
    return s.select("id", at(1).alias("first"), at(64).alias("middle"), at(128).alias("last"), F.aggregate("signature", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(_near_sql(_DOC_SOURCE) + " SELECT id AS doc_id, cluster FROM clusters")
def near_dup_clusters(spark: SparkSession, root: str) -> DataFrame:
    """The near-duplicate cluster of every document."""
    return D.near_duplicate_clusters(table(spark, root, "documents"), "doc_id", F.col("text")).withColumnRenamed("id", "doc_id")


@query(_near_sql(_DOC_SOURCE) + " SELECT id AS doc_id FROM clusters WHERE id = cluster")
def near_dup_survivors(spark: SparkSession, root: str) -> DataFrame:
    """The document that is kept of each cluster."""
    return near_dup_clusters(spark, root).where("doc_id = cluster").select("doc_id")


_CLEAN_SOURCE = f"SELECT sample_id AS id, coalesce(prompt, '') || ' ' || coalesce(response, '') AS whole FROM ({PAIRS_SQL})"


@query(_near_sql(_CLEAN_SOURCE) + " SELECT lo, hi, round(similarity, 9) AS similarity FROM pairs")
def near_dup_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Verified pairs of near-duplicate prompts and responses, between the first ones of each signature."""
    whole = F.concat(F.coalesce("prompt", F.lit("")), F.lit(" "), F.coalesce("response", F.lit("")))
    return D.NearDuplicates(_pairs(spark, root), "sample_id", whole).pairs().select("lo", "hi", F.round("similarity", 9).alias("similarity"))


_CLEAN_SQL = (
    _near_sql(_CLEAN_SOURCE)
    + f""",
texts AS (SELECT sample_id AS id, coalesce(prompt, '') AS p, coalesce(response, '') AS r FROM ({PAIRS_SQL})),
words AS (SELECT id, {words_sql('r')} AS w FROM texts),
grams AS (SELECT id, gram, count(*) AS n FROM (SELECT id, array_to_string(w[i:i+4], ' ') AS gram FROM (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 20)) GROUP BY ALL),
runs AS (SELECT id, max(n) AS run FROM (SELECT id, count(*) AS n FROM (SELECT id, c, i - row_number() OVER (PARTITION BY id, c ORDER BY i) AS island
  FROM (SELECT t.id, unnest(string_split(r, '')) AS c, generate_subscripts(string_split(r, ''), 1) AS i FROM texts t JOIN words USING (id) WHERE len(w) >= 20)) GROUP BY id, c, island) GROUP BY id),
rep AS (SELECT g.id, max(n) / sum(n)::DOUBLE > 0.3 OR any_value(run) > 200 AS repetitive FROM grams g JOIN runs USING (id) GROUP BY g.id),
judged AS (SELECT t.id, md5(p || r) AS key,
  CASE WHEN cluster <> t.id THEN 'near_duplicate' ELSE coalesce({_REASON}, CASE WHEN repetitive THEN 'repetitive' END,
    CASE WHEN length(p) < 10 OR length(r) < 10 THEN 'length_short' WHEN length(p) > 16000 OR length(r) > 24000 THEN 'length_long' END) END AS reason
  FROM texts t JOIN clusters c ON c.id = t.id JOIN ({FEATURES_SQL}) f ON f.sample_id = t.id LEFT JOIN rep ON rep.id = t.id),
firsts AS (SELECT key, min(id) AS f FROM judged WHERE reason IS NULL GROUP BY key),
outcomes AS (SELECT j.id, coalesce(reason, CASE WHEN f <> j.id THEN 'duplicate' END, 'kept') AS outcome FROM judged j LEFT JOIN firsts USING (key))"""
)


@query(_CLEAN_SQL + " SELECT id AS sample_id, outcome FROM outcomes")
def full_clean_pipeline(spark: SparkSession, root: str) -> DataFrame:
    """The flagship: every chat through near-duplicate removal, the filters and exact duplicate removal."""
    return C.clean(_pairs(spark, root), "sample_id").withColumnRenamed("id", "sample_id")
