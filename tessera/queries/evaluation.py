"""Acceptance analytics, throughput, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import arrays as A, text as T
from tessera.operators import adaptive as P, metrics as Q
from tessera.queries.corpus import words_sql
from tessera.queries.registry import query
from tessera.runtime import staged, table

#: Centres in one broadcast block.
CENTRES = 1024


def _steps(spark: SparkSession, root: str) -> DataFrame:
    """Draft steps without repeated rows: one row for each run and step."""
    return table(spark, root, "draft_steps").groupBy("run_id", "task", "sample_id", "step").agg(F.max("accept").alias("accept"), F.max("conf").alias("conf"), F.max("ent").alias("ent"))


_STEPS = """d AS (SELECT run_id, task, sample_id, step, max(accept) AS accept, max(conf) AS conf, CASE WHEN bool_or(isnan(ent)) THEN 'nan'::DOUBLE ELSE max(ent) END AS ent FROM draft_steps GROUP BY ALL)"""


def _tidy(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 7) for c in columns})


@query(f"WITH {_STEPS} SELECT task, step, round(avg(accept), 7) AS acc, round(avg(conf), 7) AS conf, round(avg(CASE WHEN NOT isnan(ent) THEN ent END), 7) AS ent, count(*) AS n FROM d GROUP BY task, step")
def per_step_means(spark: SparkSession, root: str) -> DataFrame:
    """Acceptance, confidence and entropy by task and step."""
    return _tidy(P.step_means(_steps(spark, root)), "acc", "conf", "ent")


@query(f"WITH {_STEPS}, s AS (SELECT task, step, sum(accept) AS a, count(accept) AS n FROM d GROUP BY ALL) SELECT task, step AS k, round(sum(a) OVER w / sum(n) OVER w, 7) AS acc FROM s WINDOW w AS (PARTITION BY task ORDER BY step)")
def fixed_k(spark: SparkSession, root: str) -> DataFrame:
    """Mean acceptance over all steps up to each depth."""
    return _tidy(P.fixed_depth(_steps(spark, root)), "acc")


_CHAIN = _STEPS + """, c AS (SELECT *, CASE WHEN coalesce(min(coalesce(accept, 0)) OVER (PARTITION BY run_id, task, sample_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) = 1 THEN accept ELSE -100 END AS label FROM d)"""


@query(f"WITH {_CHAIN} SELECT run_id, step, label FROM c")
def chain_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labels of steps that the chain reaches; others are ignored."""
    return P.chain_labels(_steps(spark, root), "run_id", "task", "sample_id").select("run_id", "step", "label")


@query(f"""WITH {_CHAIN} SELECT task, step, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg, count(*) FILTER (label = -100) AS ignored,
  round(coalesce(count(*) FILTER (label = 1) / nullif(count(*) FILTER (label IN (0, 1)), 0)::DOUBLE, 0), 7) AS pos_rate, round(count(*) FILTER (label = 0) / nullif(count(*) FILTER (label = 1), 0)::DOUBLE, 7) AS pos_weight FROM c GROUP BY task, step""")
def label_distribution(spark: SparkSession, root: str) -> DataFrame:
    """Positive, negative and ignored labels by task and step."""
    return _tidy(P.label_distribution(P.chain_labels(_steps(spark, root), "run_id", "task", "sample_id"), "task", "step"), "pos_rate", "pos_weight")


_EAL = _STEPS + """, alive AS (SELECT task, run_id, sample_id, step, min(coalesce(accept, 0)) OVER (PARTITION BY task, run_id, sample_id ORDER BY step) AS alive FROM d WHERE step >= 1),
a AS (SELECT task, step, sum(alive) AS a FROM alive GROUP BY ALL), n AS (SELECT task, count(DISTINCT (run_id, sample_id)) AS n FROM d GROUP BY task),
eal AS (SELECT a.task, step AS k, 1 + sum(a) OVER (PARTITION BY a.task ORDER BY step) / n::DOUBLE AS eal FROM a JOIN n ON n.task IS NOT DISTINCT FROM a.task WHERE a.task IS NOT NULL)"""


@query(f"WITH {_EAL} SELECT task, k, round(eal, 7) AS eal FROM eal")
def accepted_length(spark: SparkSession, root: str) -> DataFrame:
    """Expected accepted length at each depth."""
    return _tidy(P.accepted_length(_steps(spark, root), "run_id", "sample_id"), "eal")


def _sweep_sql(measure: str, sign: str) -> str:
    return f"""{_STEPS}, r AS (SELECT task, min({measure}) FILTER (NOT isnan({measure})) AS low, max({measure}) FILTER (NOT isnan({measure})) AS high FROM d WHERE task IS NOT NULL GROUP BY task),
t AS (SELECT task, i, low + i * (high - low) / 39 AS thr FROM r, range(40) g(i)),
k AS (SELECT d.task, run_id, sample_id, i, thr, coalesce(min(step) FILTER (step >= 1 AND NOT isnan({measure}) AND {measure} {sign} thr) - 1, max(step)) AS k FROM d JOIN t USING (task) GROUP BY ALL),
m AS (SELECT k.task, k.i, k.thr, k.k, avg(d.accept) FILTER (d.step <= k.k) AS m FROM k JOIN d USING (task, run_id, sample_id) GROUP BY k.task, k.run_id, k.sample_id, k.i, k.thr, k.k),
swept AS (SELECT task, i, thr, avg(m) AS acc, avg(k) AS mean_k FROM m GROUP BY ALL)"""


@query(f"WITH {_sweep_sql('conf', '<')} SELECT task, i, round(thr, 7) AS thr, round(acc, 7) AS acc, round(mean_k, 7) AS mean_k FROM swept")
def threshold_sweep_confidence(spark: SparkSession, root: str) -> DataFrame:
    """Acceptance and mean depth for 40 thresholds on the confidence."""
    return _tidy(P.sweep(_steps(spark, root), "conf", True, "run_id", "sample_id"), "thr", "acc", "mean_k")


@query(f"WITH {_sweep_sql('ent', '>')} SELECT task, i, round(thr, 7) AS thr, round(acc, 7) AS acc, round(mean_k, 7) AS mean_k FROM swept")
def threshold_sweep_entropy(spark: SparkSession, root: str) -> DataFrame:
    """Acceptance and mean depth for 40 thresholds on the entropy."""
    return _tidy(P.sweep(_steps(spark, root), "ent", False, "run_id", "sample_id"), "thr", "acc", "mean_k")


@query(f"WITH {_sweep_sql('conf', '<')} SELECT task, arg_max(round(thr, 7), (round(acc, 9), -i)) AS thr, round(max(acc), 7) AS acc, arg_max(round(mean_k, 7), (round(acc, 9), -i)) AS mean_k FROM swept GROUP BY task")
def best_threshold(spark: SparkSession, root: str) -> DataFrame:
    """The best threshold of each task."""
    return _tidy(P.best_threshold(P.sweep(_steps(spark, root), "conf", True, "run_id", "sample_id")), "thr", "acc", "mean_k")


@query(f"""WITH {_EAL}, adaptive AS (SELECT task, k AS i, 1 + (eal - 1) * 0.95::DOUBLE AS eal, k * 0.8::DOUBLE AS mean_k FROM eal),
f AS (SELECT task, max(eal) FILTER (k = 3) AS eal3 FROM eal GROUP BY task),
g AS (SELECT f.task, eal3, CASE WHEN eal3 > 1 THEN (eal3 - 1) / 3 ELSE 0 END AS gain_per_step, coalesce(min(k) FILTER (eal - 1 >= 0.9::DOUBLE * (eal3 - 1)), 3) AS k90_fixed FROM f JOIN eal USING (task) GROUP BY ALL),
ad AS (SELECT a.task, arg_max(struct_pack(eal := eal, mean_k := mean_k), (eal, -i)) AS best, arg_min(mean_k, i) FILTER (eal - 1 >= 0.9::DOUBLE * (eal3 - 1)) AS k90, max((eal - 1) / mean_k) FILTER (mean_k >= 0.1) AS best_efficiency FROM adaptive a JOIN f USING (task) GROUP BY a.task)
SELECT g.task, round(eal3, 7) AS eal3, round(gain_per_step, 7) AS gain_per_step, k90_fixed, round(best.eal, 7) AS adaptive_eal, round(best.mean_k, 7) AS adaptive_k, round(best.eal - 1, 7) AS adaptive_gain,
  round((best.eal - 1) / greatest(best.mean_k, 0.01), 7) AS gain_per_k, round(k90, 7) AS adaptive_k90, round(best_efficiency, 7) AS best_efficiency FROM g JOIN ad USING (task)""")
def efficiency(spark: SparkSession, root: str) -> DataFrame:
    """Gains of fixed depths against a scheme that keeps 95 % of the gain at 80 % of the depth."""
    eal = P.accepted_length(_steps(spark, root), "run_id", "sample_id").where("task IS NOT NULL")
    adaptive = eal.select("task", F.col("k").alias("i"), (1 + (F.col("eal") - 1) * 0.95).alias("eal"), (F.col("k") * F.lit(0.8)).alias("mean_k"))
    return _tidy(P.efficiency(eal, adaptive), "eal3", "gain_per_step", "adaptive_eal", "adaptive_k", "adaptive_gain", "gain_per_k", "adaptive_k90", "best_efficiency")


_REQ = "r AS (SELECT DISTINCT ON (request_id) * FROM request_counters ORDER BY request_id, arrived_at DESC, completion_tokens DESC, spec_verify_ct DESC NULLS LAST)"


def _requests(spark: SparkSession, root: str) -> DataFrame:
    """The last delivery of each request."""
    r = table(spark, root, "request_counters")
    row = F.struct(*r.columns)
    return r.groupBy("request_id").agg(F.max_by(row, F.struct("arrived_at", "completion_tokens", "spec_verify_ct")).alias("r")).select("r.*")


@query(f"""WITH {_REQ} SELECT task, count(*) AS requests, sum(completion_tokens)::BIGINT AS tokens, sum(spec_verify_ct)::BIGINT AS verified,
  round(coalesce(sum(completion_tokens) FILTER (spec_verify_ct IS NOT NULL) / sum(spec_verify_ct)::DOUBLE, 1), 7) AS accept_length FROM r GROUP BY task""")
def accept_length_ratio(spark: SparkSession, root: str) -> DataFrame:
    """Accept length of each task: tokens by verify steps, as a ratio of sums; redelivered requests count once."""
    return _tidy(P.request_totals(_requests(spark, root), "task"), "accept_length")


@query(f"""WITH {_REQ}, t AS (SELECT task, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS tokens, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM r GROUP BY task)
SELECT task, prompt_tokens, tokens, round(n / nullif(us / 1e6, 0), 7) AS requests_per_s, round(tokens / nullif(us / 1e6, 0), 7) AS tokens_per_s FROM t""")
def throughput(spark: SparkSession, root: str) -> DataFrame:
    """Tokens, requests a second and tokens a second over the time that a task's requests span."""
    span = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / F.lit(1e6)
    t = _requests(spark, root).groupBy("task").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), span.alias("s"))
    s = F.nullif(F.col("s"), F.lit(0.0))
    return t.select("task", "prompt_tokens", "tokens", F.round(F.col("n") / s, 7).alias("requests_per_s"), F.round(F.col("tokens") / s, 7).alias("tokens_per_s"))


@query(f"WITH {_REQ} SELECT finish_reason.type AS reason, count(*) AS n, round(avg(finish_reason.length), 7) AS mean_length, coalesce(bool_or(finish_reason.type = 'length'), false) AS finished_by_length FROM r GROUP BY 1")
def finish_reasons(spark: SparkSession, root: str) -> DataFrame:
    """How requests end."""
    return _requests(spark, root).groupBy(F.col("finish_reason.type").alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("finish_reason.length"), 7).alias("mean_length"), F.coalesce(F.bool_or(F.col("finish_reason.type") == "length"), F.lit(False)).alias("finished_by_length")
    )


@query(f"""WITH {_REQ}, b AS (SELECT task, CASE WHEN completion_tokens < 64 THEN 0 WHEN completion_tokens < 256 THEN 1 WHEN completion_tokens < 1024 THEN 2 ELSE 3 END AS bucket FROM r WHERE completion_tokens IS NOT NULL)
SELECT task, bucket, count(*) AS n FROM b GROUP BY ALL""")
def token_histogram(spark: SparkSession, root: str) -> DataFrame:
    """Histogram over explicit bounds."""
    bounds = F.array(F.lit(64), F.lit(256), F.lit(1024))
    bucket = A.upper_bound(bounds, F.col("completion_tokens"))
    return _requests(spark, root).where("completion_tokens IS NOT NULL").select("task", bucket.alias("bucket")).groupBy("task", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_REQ} SELECT date_trunc('day', ts)::DATE::VARCHAR AS day, sum(prompt_tokens - coalesce(cached_tokens, 0))::BIGINT AS prefill, sum(completion_tokens)::BIGINT AS decode,
 round(sum(completion_tokens) / nullif(sum(completion_tokens) + sum(prompt_tokens - coalesce(cached_tokens, 0)), 0)::DOUBLE, 7) AS decode_share FROM r GROUP BY 1""")
def batch_composition(spark: SparkSession, root: str) -> DataFrame:
    """Prefill and decode tokens by day."""
    prefill, decode = F.sum(F.col("prompt_tokens") - F.coalesce("cached_tokens", F.lit(0))), F.sum("completion_tokens")
    return _requests(spark, root).groupBy(F.to_date("ts").cast("string").alias("day")).agg(prefill.alias("prefill"), decode.alias("decode"), F.round(F.try_divide(decode, decode + prefill), 7).alias("decode_share"))


@query(f"WITH {_STEPS}, b AS (SELECT (conf > 0.5)::INT AS p, accept AS y FROM d WHERE conf IS NOT NULL AND accept IS NOT NULL), c AS (SELECT count(*) FILTER (p=1 AND y=1)::DOUBLE tp, count(*) FILTER (p=1 AND y=0)::DOUBLE fp, count(*) FILTER (p=0 AND y=1)::DOUBLE fn, count(*) FILTER (p=0 AND y=0)::DOUBLE tn FROM b) SELECT round((tp+tn)/(tp+fp+fn+tn), 7) AS acc, round(2*tp/(2*tp+fp+fn), 7) AS f1, round(((tp+tn)/(tp+fp+fn+tn) + 2*tp/(2*tp+fp+fn))/2, 7) AS acc_and_f1, round(coalesce((tp*tn-fp*fn)/nullif(sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)),0),0), 7) AS mcc FROM c")
def classification_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Confidence above one half as a prediction of acceptance: accuracy, F1 and Matthews' correlation."""
    rows = _steps(spark, root).where("conf IS NOT NULL AND accept IS NOT NULL").select((F.col("conf") > 0.5).cast("int").alias("p"), F.col("accept").alias("y"))
    made = Q.acc_and_f1(F.col("p"), F.col("y")) | Q.matthews(F.col("p"), F.col("y"))
    return rows.agg(*[F.round(c, 7).alias(n) for n, c in made.items()])


@query(f"""WITH {_STEPS}, v AS (SELECT task, conf AS x, ent AS y FROM d WHERE conf IS NOT NULL AND ent IS NOT NULL AND NOT isnan(ent)),
r AS (SELECT *, rank() OVER (PARTITION BY task ORDER BY x) + (count(*) OVER (PARTITION BY task, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY task ORDER BY y) + (count(*) OVER (PARTITION BY task, y) - 1) / 2.0::DOUBLE AS ry FROM v)
SELECT task, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round((corr(x, y) + corr(rx, ry)) / 2, 6) AS mean FROM r WHERE task IS NOT NULL GROUP BY task""")
def correlations(spark: SparkSession, root: str) -> DataFrame:
    """Pearson's and Spearman's correlation of confidence and entropy by task."""
    c = Q.correlations(_steps(spark, root).where("task IS NOT NULL AND NOT isnan(ent)"), "conf", "ent", "task")
    return c.select("task", *[F.round(x, 6).alias(x) for x in ("pearson", "spearman", "mean")])


@query(f"WITH {_STEPS} SELECT task, round(sum((1 - conf) * accept) / nullif(sum(CASE WHEN conf IS NOT NULL THEN accept END), 0), 7) AS loss, round(coalesce(avg(conf), 'nan'), 7) AS mean_conf, count(*) AS n FROM d GROUP BY task")
def masked_mean_loss(spark: SparkSession, root: str) -> DataFrame:
    """Mean of a loss over the positions that a mask keeps."""
    loss, mask = 1 - F.col("conf"), F.when(F.col("conf").isNotNull(), F.col("accept"))
    m = Q.weighted_loss(loss, mask)["loss"]
    return _steps(spark, root).groupBy("task").agg(F.round(m, 7).alias("loss"), F.round(Q.mean(F.col("conf"))["mean"], 7).alias("mean_conf"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_STEPS}, w AS (SELECT run_id, sum((1 - conf) * CASE step WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 WHEN 3 THEN 0.2 ELSE 1 END) AS loss, count(*) AS n FROM d WHERE conf IS NOT NULL GROUP BY run_id) SELECT run_id, round(loss, 7) AS loss FROM w WHERE n = 4")
def weighted_step_loss(spark: SparkSession, root: str) -> DataFrame:
    """Loss of step 0 plus the weighted losses of steps 1 to 3, of complete runs."""
    weights = {1: 0.5, 2: 0.3, 3: 0.2}
    if abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("the weights must add up to 1")
    w = F.lit(1.0)
    for step, x in weights.items():
        w = F.when(F.col("step") == step, x).otherwise(w)
    sums = _steps(spark, root).where("conf IS NOT NULL").groupBy("run_id").agg(F.sum((1 - F.col("conf")) * w).alias("loss"), F.count(F.lit(1)).alias("n"))
    return sums.where("n = 4").select("run_id", F.round("loss", 7).alias("loss"))


@query(f"""
WITH p AS (SELECT sample_id AS id, messages[1].content AS a, messages[2].content AS b FROM chats WHERE len(messages) >= 2 AND messages[1].content IS NOT NULL AND messages[2].content IS NOT NULL),
x AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest({words_sql('a')}) AS w FROM p) GROUP BY ALL), y AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest({words_sql('b')}) AS w FROM p) GROUP BY ALL)
SELECT id AS sample_id, round(2.0::DOUBLE * sum(least(coalesce(x.n, 0), coalesce(y.n, 0))) / (sum(coalesce(x.n, 0)) + sum(coalesce(y.n, 0))), 7) AS rouge_1 FROM x FULL JOIN y USING (id, w) GROUP BY id""")
def rouge_unigrams(spark: SparkSession, root: str) -> DataFrame:
    """Overlap of words between a prompt and its response."""
    m = F.col("messages")
    rows = table(spark, root, "chats").where(F.size(m) >= 2).select("sample_id", m[0]["content"].alias("a"), m[1]["content"].alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return Q.unigram_overlap(rows, "sample_id", T.words(F.col("a")), T.words(F.col("b"))).select(F.col("id").alias("sample_id"), F.round("rouge_1", 7).alias("rouge_1"))


@query()
def generation_quality(spark: SparkSession, root: str) -> DataFrame:
    """Mean ROUGE-1, 2, L and BLEU-4 of responses against their prompts."""
    m = F.col("messages")
    rows = table(spark, root, "chats").where(F.size(m) >= 2).select(m[0]["content"].alias("wanted"), m[1]["content"].alias("said"))
    return Q.generation_quality(rows, "said", "wanted")


@query("""
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS square, list_position(embedding, list_max(embedding)) - 1 AS top
FROM embeddings""")
def embedding_stats(spark: SparkSession, root: str) -> DataFrame:
    """Squared length and place of the largest coordinate of each vector."""
    e = F.col("embedding")
    return table(spark, root, "embeddings").select("vec_id", F.round(A.dot(e, e), 5).alias("square"), A.argmax(e).cast("long").alias("top"))


@query("""
WITH c AS (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
v AS (SELECT label, list(x ORDER BY i) AS centre FROM c GROUP BY label),
s AS (SELECT e.vec_id, e.label = v.label AS own, list_cosine_similarity(list_transform(e.embedding, lambda x: x::DOUBLE), v.centre) AS cos FROM embeddings e, v)
SELECT vec_id, round(max(cos) FILTER (own), 6) AS positive, round(avg(cos) FILTER (NOT own), 6) AS mean_negative, round(max(cos) FILTER (own) - max(cos) FILTER (NOT own), 6) AS margin FROM s GROUP BY vec_id""")
def embedding_margin(spark: SparkSession, root: str) -> DataFrame:
    """Similarity to the own label's centre, mean to others, and margin; centres are one row for each label."""
    e = table(spark, root, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    mean = e.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centres = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centre"))
    centres = staged(centres)
    blocks = max(1, -(-centres.count() // CENTRES))  # a block of centres is broadcast; a vector is compared with one block after the other
    packed = centres.groupBy(F.pmod(F.xxhash64("label"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("label", "centre")).alias("centres"))
    parts = []
    for block in range(blocks):
        rows = e.withColumn("block", F.lit(block).cast("long")).join(F.broadcast(packed.where(F.col("block") == block)), "block")
        scored = F.transform("centres", lambda c: F.struct((c["label"] == F.col("label")).alias("own"), A.cosine(F.col("e"), c["centre"]).alias("cos")))
        rows = rows.select("vec_id", scored.alias("s"))
        cos = lambda own: F.transform(F.filter("s", lambda x: x["own"] == F.lit(own)), lambda x: x["cos"])
        total = F.aggregate(cos(False), F.lit(0.0), lambda a, x: a + x)
        parts.append(rows.select("vec_id", F.array_max(cos(True)).alias("own"), F.array_max(cos(False)).alias("other"), total.alias("total"), F.size(cos(False)).alias("n")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    merged = union.groupBy("vec_id").agg(F.max("own").alias("own"), F.max("other").alias("other"), F.try_divide(F.sum("total"), F.sum("n")).alias("mean"))
    return merged.select("vec_id", F.round("own", 6).alias("positive"), F.round("mean", 6).alias("mean_negative"), F.round(F.col("own") - F.col("other"), 6).alias("margin"))


@query("""
WITH c AS (SELECT DISTINCT id, orm FROM candidates WHERE orm IS NOT NULL AND len(list_filter(orm, lambda x: x IS NULL)) = 0 AND len(orm) > 0),
e AS (SELECT id, orm, list_sum(list_transform(orm, lambda x: exp(x))) AS z FROM c),
p AS (SELECT id, orm, list_transform(orm, lambda x: exp(x) / z) AS p FROM e)
SELECT id, list_position(p, list_max(p)) - 1 AS best, round(list_max(p), 7) AS top, round(-list_sum(list_transform(p, lambda q: q * ln(q + 1e-12))), 7) AS entropy, count(*) AS n FROM p GROUP BY ALL""")
def score_softmax(spark: SparkSession, root: str) -> DataFrame:
    """Softmax over the scores of a row: best place, its probability, entropy."""
    s = F.col("orm")
    rows = table(spark, root, "candidates").where(s.isNotNull() & (F.size(s) > 0) & ~F.exists(s, lambda x: x.isNull())).select("id", "orm").distinct()
    p = rows.select("id", A.softmax(s).alias("p"))
    return p.select("id", A.argmax(F.col("p")).cast("long").alias("best"), F.round(F.array_max("p"), 7).alias("top"), F.round(A.entropy(F.col("p")), 7).alias("entropy")).groupBy("id", "best", "top", "entropy").agg(F.count(F.lit(1)).alias("n"))
