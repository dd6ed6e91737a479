"""Series, roll-ups, comparisons, lookups and trees over the event stream and the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.functions import arrays as A, text as T
from tessera.operators import reports as R, series as S
from tessera.queries.registry import query
from tessera.runtime import table

TYPES = ["click", "error", "purchase", "signup", "view"]


def _events(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events")


@query("""WITH r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events WHERE value IS NOT NULL)
SELECT a.event_id, round(sum(b.value * pow(0.9::DOUBLE, a.n - b.n)) / sum(pow(0.9::DOUBLE, a.n - b.n)), 6) AS smoothed FROM r a JOIN r b ON a.event_type = b.event_type AND b.n <= a.n AND b.n > a.n - 400 GROUP BY a.event_id""")
def ema_smoothing(spark: SparkSession, root: str) -> DataFrame:
    """Debiased exponential average of each type's values (the SQL leaves out weights below 1e-18)."""
    return S.smoothed(_events(spark, root).select("event_id", "event_type", "value"), "event_type", "event_id", "value").select("event_id", F.round("smoothed", 6).alias("smoothed"))


@query("""WITH t AS (SELECT *, max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events)
SELECT event_id, coalesce(isnan(value), false) AS is_invalid, coalesce(value > 2 * top, false) AS is_spike FROM t""")
def spike_guard(spark: SparkSession, root: str) -> DataFrame:
    """Values that are invalid, or above twice the largest so far."""
    return S.spikes(_events(spark, root).select("event_id", "event_type", "value"), "event_type", "event_id", "value", 2.0).select("event_id", "is_invalid", "is_spike")


@query("""WITH t AS (SELECT event_id, event_type, value, max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events)
SELECT event_id, sum(CASE WHEN best IS NOT NULL AND NOT coalesce(value > best, false) THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY event_id)::BIGINT AS stalled FROM t""")
def early_stop_counter(spark: SparkSession, root: str) -> DataFrame:
    """Saves so far that didn't improve."""
    return S.stalls(_events(spark, root).select("event_id", "event_type", "value"), "event_type", "event_id", "value").select("event_id", F.col("stalled").cast("long").alias("stalled"))


@query("""SELECT event_id, round(100.0::DOUBLE * row_number() OVER (ORDER BY event_id) / count(*) OVER (), 6) AS percent FROM events""")
def progress(spark: SparkSession, root: str) -> DataFrame:
    """Share of events seen so far."""
    from tessera.operators.sampling import numbered

    e = _events(spark, root).select("event_id")
    total = e.count()
    return numbered(e, "event_id").select("event_id", F.round(F.lit(100.0) * (F.col("row_no") + 1) / total, 6).alias("percent"))


@query("""WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS rn FROM c)
SELECT event_type, sum(n)::BIGINT AS n, list(user_id ORDER BY user_id) FILTER (rn <= 3) AS examples FROM r GROUP BY event_type""")
def error_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Events of each type with their first users as examples."""
    return R.error_rollup(_events(spark, root), "event_type", "user_id")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, sum(n)::BIGINT AS n, count(*) AS kinds, arg_min(event_type, (-n, event_type)) AS major, max(n) AS major_n FROM c GROUP BY user_id""")
def major_error(spark: SparkSession, root: str) -> DataFrame:
    """By user the number of events and the commonest type."""
    return R.nested_counts(_events(spark, root), "user_id", "event_type")


@query("SELECT user_id, " + ", ".join(f"arg_min(value, event_id) FILTER (event_type = '{t}') AS \"{t}\"" for t in TYPES) + " FROM events GROUP BY user_id")
def pivot_status(spark: SparkSession, root: str) -> DataFrame:
    """First value of each type by user."""
    return R.pivot_first(_events(spark, root), "user_id", "event_type", "value", "event_id", TYPES)


_DAYS = "WITH a AS (SELECT DISTINCT user_id * 100 + hour(ts) AS k FROM events WHERE day(ts) <= 10), b AS (SELECT DISTINCT user_id * 100 + hour(ts) AS k FROM events WHERE day(ts) > 20)"


def _runs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    e = _events(spark, root).select((F.col("user_id") * 100 + F.hour("ts")).alias("k"), F.day("ts").alias("d"), "value")
    return e.where("d <= 10"), e.where("d > 20")


@query(_DAYS + " SELECT k, 'removed' AS change FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'added' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)")
def run_diff(spark: SparkSession, root: str) -> DataFrame:
    """Users and hours of the first ten days against the last ones: what went and came."""
    return R.run_diff(*_runs(spark, root), "k")


@query("WITH a AS (SELECT user_id AS k, count(*) AS n FROM events WHERE day(ts) <= 10 GROUP BY 1), b AS (SELECT user_id AS k, count(*) AS n FROM events WHERE day(ts) > 20 GROUP BY 1) SELECT k, a.n AS before, b.n AS after FROM a FULL JOIN b USING (k)")
def run_join(spark: SparkSession, root: str) -> DataFrame:
    """Counts of two runs side by side."""
    e = _events(spark, root)
    count = lambda d: d.groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return R.joined_runs(count(e.where(F.day("ts") <= 10)), count(e.where(F.day("ts") > 20)), "k", "n")


@query("""SELECT event_type, list(DISTINCT user_id ORDER BY user_id) FILTER (value >= 10) AS ran, list(DISTINCT user_id ORDER BY user_id) FILTER (value < 10) AS skipped,
 round(count(*) FILTER (value < 10) / count(*)::DOUBLE, 4) AS share, list(DISTINCT props->>'k' ORDER BY props->>'k') FILTER (value < 10) AS reasons FROM events GROUP BY event_type""")
def skip_report(spark: SparkSession, root: str) -> DataFrame:
    """Users over and under a value by type, the share under it, and the distinct properties there."""
    r = R.skip_report(_events(spark, root), "event_type", "user_id", F.col("value") < 10, F.get_json_object("props", "$.k"))
    return r


@query("SELECT u.user_id, t.event_type, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM events) u, (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('none')) t(event_type) LEFT JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) c ON c.user_id = u.user_id AND c.event_type = t.event_type")
def complete_grid(spark: SparkSession, root: str) -> DataFrame:
    """Counts by user and type, with 0 for what didn't happen."""
    counts = _events(spark, root).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return R.complete_grid(counts, counts, "user_id", "event_type", [*TYPES, "none"], "n", 0)


@query("SELECT user_id, day(ts)::INT AS day, round_even((epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts)))) / 60.0::DOUBLE, 0)::BIGINT AS minutes FROM events GROUP BY ALL")
def job_duration(spark: SparkSession, root: str) -> DataFrame:
    """Minutes between a user's first and last event of a day, rounded half to even."""
    return _events(spark, root).groupBy("user_id", F.day("ts").alias("day")).agg(R.half_even_minutes(F.min("ts"), F.max("ts")).alias("minutes"))


@query("""SELECT event_type, sum(s)::BIGINT AS seconds, (sum(s)::BIGINT // 3600) || 'h' || (sum(s)::BIGINT % 3600 // 60) || 'm' || (sum(s)::BIGINT % 60) || 's' AS shown
FROM (SELECT event_type, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s FROM events) GROUP BY event_type""")
def duration_totals(spark: SparkSession, root: str) -> DataFrame:
    """Sums of durations given as h:m:s texts."""
    text = F.concat_ws(":", F.hour("ts"), F.minute("ts"), F.second("ts"))
    s = _events(spark, root).groupBy("event_type").agg(F.sum(R.duration_seconds(text)).cast("long").alias("seconds"))
    return s.select("event_type", "seconds", R.duration_text(F.col("seconds")).alias("shown"))


@query("""SELECT coalesce(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_name END, n_name, 'unknown') AS author, event_type, count(*) AS failures
FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN nation ON n_nationkey = c_nationkey WHERE event_type = 'error' OR value > 50 GROUP BY ALL""")
def failures_by_author(spark: SparkSession, root: str) -> DataFrame:
    """Failures by author: a customer of the team's segments, else who merged the work, their nation."""
    c, n = table(spark, root, "customer"), table(spark, root, "nation")
    failed = _events(spark, root).where("event_type = 'error' OR value > 50").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    people = c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_name")).alias("own"), "n_name")
    return failed.join(people, "user_id", "left").groupBy(F.coalesce("own", "n_name", F.lit("unknown")).alias("author"), "event_type").agg(F.sum("n").alias("failures"))


@query("""SELECT event_type, round(avg(k), 6) AS mean_k, count(k) AS n FROM (SELECT event_type, try_cast(props->>'k' AS INT) AS k, props->'missing' AS m FROM events) GROUP BY event_type""")
def json_path_metric(spark: SparkSession, root: str) -> DataFrame:
    """A metric taken from JSON by path; missing paths are skipped."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return _events(spark, root).groupBy("event_type").agg(F.round(F.avg(k), 6).alias("mean_k"), F.count(k).alias("n"))


@query("""WITH f AS (SELECT user_id, event_type, day(ts)::INT AS d, arg_min(value, event_id) AS v FROM events GROUP BY ALL), m AS (SELECT user_id, event_type, count(*) AS days, round(sum(v), 6) AS total FROM f GROUP BY ALL)
SELECT user_id, count(*) AS types, sum(days)::BIGINT AS days, round(sum(total), 4) AS total FROM m GROUP BY user_id""")
def nested_first_wins(spark: SparkSession, root: str) -> DataFrame:
    """User, type, day: the first value wins at the innermost level; the levels rolled up."""
    f = _events(spark, root).groupBy("user_id", "event_type", F.day("ts").alias("d")).agg(F.min_by("value", "event_id").alias("v"))
    maps = f.groupBy("user_id", "event_type").agg(F.map_from_entries(F.collect_list(F.struct("d", "v"))).alias("by_day"))
    total = F.aggregate(F.map_values("by_day"), F.lit(0.0), lambda a, x: a + x)
    return maps.groupBy("user_id").agg(F.count(F.lit(1)).alias("types"), F.sum(F.size("by_day")).alias("days"), F.round(F.sum(total), 4).alias("total"))


@query("""WITH s AS (SELECT lower(replace(trim(source), '-', '_')) AS name, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1), reg(prefix, family) AS (VALUES ('distill', 'distilled'), ('distill_code', 'code'), ('zh', 'chinese'), ('long_reading', 'long'))
SELECT name, n, (SELECT family FROM reg WHERE name = prefix OR starts_with(name, prefix || '_') ORDER BY length(prefix) DESC LIMIT 1) AS family FROM s""")
def prefix_lookup(spark: SparkSession, root: str) -> DataFrame:
    """The family of each source by the longest prefix that a registry holds."""
    name = F.lower(F.translate(F.trim("source"), "-", "_"))
    sources = table(spark, root, "documents").where("source IS NOT NULL").groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    registry = spark.createDataFrame([("distill", "distilled"), ("distill_code", "code"), ("zh", "chinese"), ("long_reading", "long")], "prefix string, family string")
    return R.prefix_lookup(sources, "name", registry, "prefix", "family").select("name", "n", "family")


@query("""SELECT doc_id, CASE source WHEN 'rag_digest' THEN 'retrieval' WHEN 'distill_math' THEN 'math' WHEN 'distill_code' THEN 'code' ELSE 'other' END AS found FROM documents""")
def priority_lookup(spark: SparkSession, root: str) -> DataFrame:
    """A value from the first of three lookup tables that holds the key."""
    make = lambda rows: spark.createDataFrame(rows, "k string, v string")
    dims = [make([("rag_digest", "retrieval")]), make([("distill_math", "math"), ("rag_digest", "never")]), make([("distill_code", "code"), ("distill_math", "never")])]
    return R.first_lookup(table(spark, root, "documents").select("doc_id", "source"), "source", [(d, "k", "v") for d in dims], "other").select("doc_id", "found")


@query("""WITH d AS (SELECT run_id, step, max(accept) AS accept, max(conf) AS conf FROM draft_steps GROUP BY ALL HAVING max(conf) IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) - 1 = step AS whole FROM d),
q AS (SELECT run_id, step, count(*) OVER w AS depth, avg(accept) OVER w AS mo, min(accept::DOUBLE) OVER w AS mio, avg(conf) OVER w AS mp, min(conf) OVER w AS mip FROM p WHERE whole WINDOW w AS (PARTITION BY run_id ORDER BY step))
SELECT run_id AS tree, step AS node, depth::INT AS depth, round(mo, 7) AS mean_outcome, round(mio, 7) AS min_outcome, round(mp, 7) AS mean_process, round(mip, 7) AS min_process FROM q""")
def tree_path_rewards(spark: SparkSession, root: str) -> DataFrame:
    """Steps of a run as a path from the root: mean and least rewards down to each node."""
    d = table(spark, root, "draft_steps").groupBy("run_id", "step").agg(F.max("accept").alias("accept"), F.max("conf").alias("conf")).where("conf IS NOT NULL")
    nodes = d.select("run_id", "step", F.when(F.col("step") > 0, F.col("step") - 1).alias("parent"), "accept", "conf")
    t = R.tree_paths(nodes, "run_id", "step", "parent", "accept", "conf")
    return t.select("tree", "node", "depth", *[F.round(c, 7).alias(c) for c in ("mean_outcome", "min_outcome", "mean_process", "min_process")])


@query("""WITH d AS (SELECT task, sample_id, run_id, round(avg(conf), 7) AS s FROM draft_steps WHERE conf IS NOT NULL AND sample_id IS NOT NULL GROUP BY ALL)
SELECT sample_id AS parent, arg_max(run_id, (s, run_id)) AS good, max(s) AS good_score, arg_min(run_id, (s, run_id)) AS bad, min(s) AS bad_score FROM d GROUP BY sample_id HAVING max(s) - min(s) > 0.2""")
def tree_preference_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Best and worst run of each question where they differ enough."""
    d = table(spark, root, "draft_steps").where("conf IS NOT NULL AND sample_id IS NOT NULL").groupBy("sample_id", "run_id").agg(F.round(F.avg("conf"), 7).alias("s"))
    return R.preference_pairs(d.withColumn("tree", F.lit(0)), "tree", "run_id", "sample_id", "s", 0.2).drop("tree").withColumnRenamed("sample_id", "parent")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, starts_with(ltrim(line), '```') AS mark, sum(starts_with(ltrim(line), '```')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l)
SELECT doc_id, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM m WHERE NOT mark AND n % 2 = 1 GROUP BY doc_id""")
def fenced_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines between opening and closing marks of each document."""
    lines = table(spark, root, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return S.marker_parity(lines, ["doc_id"], "i", F.startswith(F.ltrim("line"), F.lit("```"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
f AS (SELECT *, regexp_matches(line, '^[ \\t]+[^\\s]') AS ind FROM l), g AS (SELECT *, (ind AND NOT coalesce(lag(ind) OVER (PARTITION BY doc_id ORDER BY i), false))::INT AS new FROM f),
b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM g), t AS (SELECT doc_id, block, string_agg(line, chr(10) ORDER BY i) AS block_text FROM b WHERE ind GROUP BY doc_id, block)
SELECT DISTINCT md5(block_text) AS block_md5 FROM t WHERE contains(block_text, 'return')""".replace("\\\\", "\\"))
def indented_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Distinct blocks of indented lines that name a target."""
    lines = table(spark, root, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return S.indented_blocks(lines, ["doc_id"], "i", "line").where(F.contains(F.col("block"), F.lit("return"))).select(F.md5("block").alias("block_md5")).distinct()


@query("""WITH c AS (SELECT lower(replace(trim(source), '-', '_')) AS source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1) SELECT source, n, round(n / sum(n) OVER ()::DOUBLE, 7) AS share FROM c""")
def domain_shares(spark: SparkSession, root: str) -> DataFrame:
    """Documents of each source and their share."""
    c = table(spark, root, "documents").where("source IS NOT NULL").groupBy(F.lower(F.translate(F.trim("source"), "-", "_")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("source", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 7).alias("share"))  # a row for each source


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT '| event_type | n |' || chr(10) || '|-|-|' || chr(10) || string_agg('| ' || event_type || ' | ' || n || ' |', chr(10) ORDER BY n DESC, event_type) AS report FROM c""")
def markdown_report(spark: SparkSession, root: str) -> DataFrame:
    """A Markdown table of the commonest types."""
    return R.markdown(_events(spark, root).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), ["event_type", "n"], "n", 10)


@query("""WITH t(w, h) AS (VALUES (1, 1), (1, 2), (2, 1), (3, 2), (2, 3))
SELECT doc_id, arg_min(w || ':' || h, (abs(r - w / h::DOUBLE), -w * h, w)) AS ratio FROM (SELECT doc_id, (n_tokens % 7 + 1) / 3.0::DOUBLE AS r FROM documents WHERE n_tokens IS NOT NULL), t GROUP BY doc_id, r""")
def nearest_ratio(spark: SparkSession, root: str) -> DataFrame:
    """The nearest of a few ratios; of equally near ones the larger area."""
    r = (F.col("n_tokens") % 7 + 1) / F.lit(3.0)
    options = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in ((1, 1), (1, 2), (2, 1), (3, 2), (2, 3))])
    best = F.array_min(F.transform(options, lambda o: F.struct(F.abs(r - o["w"] / o["h"].cast("double")).alias("d"), (-o["w"] * o["h"]).alias("a"), o["w"].alias("w"), o["h"].alias("h"))))
    return table(spark, root, "documents").where("n_tokens IS NOT NULL").select("doc_id", F.concat_ws(":", best["w"], best["h"]).alias("ratio"))


@query("""WITH e AS (SELECT DISTINCT id, i - 1 AS pos, orm[i] AS s FROM (SELECT id, orm, unnest(range(1, len(orm) + 1)) AS i FROM candidates WHERE orm IS NOT NULL) WHERE orm[i] IS NOT NULL)
SELECT id, pos::INT AS pos, round(exp(s) / sum(exp(s)) OVER (PARTITION BY id), 7) AS p, rank() OVER (PARTITION BY id ORDER BY s DESC) AS rk FROM e""")
def candidate_softmax(spark: SparkSession, root: str) -> DataFrame:
    """Softmax over the candidates of a sequence, and their rank."""
    e = table(spark, root, "candidates").where("orm IS NOT NULL").select("id", F.posexplode("orm").alias("pos", "s")).where("s IS NOT NULL").distinct()
    w = Window.partitionBy("id")
    return e.select("id", "pos", F.round(F.exp("s") / F.sum(F.exp("s")).over(w), 7).alias("p"), F.rank().over(w.orderBy(F.desc("s"))).cast("long").alias("rk"))


@query("""WITH t AS (SELECT vec_id, i - 1 AS i, embedding[i] AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings) WHERE (i - 1) IN (3, 7, 11, 60)),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS rk FROM t) SELECT vec_id, i::INT AS i, rk FROM r WHERE rk <= least(6, 4)""")
def targeted_top_k(spark: SparkSession, root: str) -> DataFrame:
    """The best of a subset of targets, at most as many as there are."""
    targets, k = [3, 7, 11, 60], 6
    e = table(spark, root, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).where(F.col("i").isin(targets))
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("x"), "i")).cast("long")
    return e.select("vec_id", "i", rank.alias("rk")).where(F.col("rk") <= min(k, len(targets)))


_KINDS = {"image": "jpg jpeg png gif bmp webp tiff", "audio": "mp3 wav flac ogg m4a aac", "video": "mp4 avi mov mkv webm flv", None: "txt json parquet py"}
_EXTENSIONS = [x for own in _KINDS.values() for x in own.split()]


@query(rf"""SELECT sample_id, count(*) FILTER (regexp_matches(c, '[\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{F900}}-\x{{FAFF}}\x{{20000}}-\x{{2A6DF}}\x{{2A700}}-\x{{2B73F}}\x{{2B740}}-\x{{2B81F}}\x{{2B820}}-\x{{2CEAF}}\x{{2F800}}-\x{{2FA1F}}]')) AS cjk, count(c) AS texts
FROM (SELECT sample_id, unnest(messages).content AS c FROM chats WHERE len(messages) > 0) GROUP BY sample_id""")
def char_classes(spark: SparkSession, root: str) -> DataFrame:
    """How many messages of each chat hold ideographs."""
    m = F.col("messages.content")
    held = F.size(F.filter(m, lambda c: F.coalesce(T.is_cjk(c), F.lit(False))))
    return table(spark, root, "chats").where("size(messages) > 0").select("sample_id", held.cast("long").alias("cjk"), F.size(F.filter(m, lambda c: c.isNotNull())).cast("long").alias("texts"))


@query(f"""WITH e AS (SELECT line_id, file_name, {_EXTENSIONS!r}[1 + line_id % {len(_EXTENSIONS)}] AS x FROM raw_lines)
SELECT line_id, CASE {' '.join(f"WHEN x IN ({', '.join(repr(x) for x in own.split())}) THEN '{kind}'" for kind, own in _KINDS.items() if kind)} END AS kind FROM e""")
def file_kinds(spark: SparkSession, root: str) -> DataFrame:
    """The kind of the file that each delivered line would name, by extensions of all kinds, in either case, with and without a query."""
    x = F.get(F.array(*map(F.lit, _EXTENSIONS)), F.pmod("line_id", F.lit(len(_EXTENSIONS))).cast("int"))
    name = F.concat(F.col("file_name"), F.lit("."), F.when(F.col("line_id") % 2 == 0, F.upper(x)).otherwise(x), F.when(F.col("line_id") % 3 == 0, "?size=2.5").otherwise(""))
    return table(spark, root, "raw_lines").select("line_id", T.file_kind(name).alias("kind"))


@query("SELECT count(*) AS n, round(avg(1 / (1 + exp(-value / 100))), 7) AS mean_sigmoid FROM events WHERE value IS NOT NULL")
def sigmoid_mean(spark: SparkSession, root: str) -> DataFrame:
    """Mean of a sigmoid."""
    return _events(spark, root).where("value IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(A.sigmoid(F.col("value") / 100)), 7).alias("mean_sigmoid"))
