"""Operators on encoded rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import arrays as A
from tessera.operators import tokens as K
from tessera.queries.registry import query
from tessera.runtime import table


def _rows(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "encoded_rows")


def _text(c):
    return F.md5(F.array_join(c, ",", "-"))


_JOIN = "md5(array_to_string(list_transform({0}, lambda x: coalesce(x::VARCHAR, '-')), ','))"


@query(f"""
SELECT row_id, {_JOIN.format('list_concat(input_ids[:64], list_transform(range(greatest(0, 64 - len(input_ids))), lambda i: 0))')} AS right_md5,
  {_JOIN.format('list_concat(list_transform(range(greatest(0, 64 - len(input_ids))), lambda i: 0), input_ids[:64])')} AS left_md5, least(64, len(input_ids)) AS n_real
FROM encoded_rows WHERE input_ids IS NOT NULL""")
def pad_or_truncate(spark: SparkSession, root: str) -> DataFrame:
    """Token ids cut or padded to 64 at either end, and the number of real ones."""
    ids = F.col("input_ids")
    return _rows(spark, root).where(ids.isNotNull()).select(
        "row_id", _text(A.padded(ids, 64, F.lit(0))).alias("right_md5"), _text(A.padded(ids, 64, F.lit(0), left=True)).alias("left_md5"),
        F.aggregate(A.attention_mask(ids, 64), F.lit(0), lambda a, x: a + x).cast("long").alias("n_real"),
    )


@query(f"SELECT row_id, {_JOIN.format('CASE WHEN len(labels) > 0 THEN list_append(labels[2:], -100) ELSE labels END')} AS rolled_md5, len(list_filter(labels, lambda x: x <> -100)) AS counted FROM encoded_rows WHERE labels IS NOT NULL")
def label_roll(spark: SparkSession, root: str) -> DataFrame:
    """Labels shifted to the next token, and how many count."""
    y = F.col("labels")
    return _rows(spark, root).where(y.isNotNull()).select("row_id", _text(A.rolled(y, F.lit(A.IGNORED))).alias("rolled_md5"), A.counted_labels(y).cast("long").alias("counted"))


@query("""
SELECT row_id, len(list_filter(range(1, least(len(input_ids), len(labels) - 1) + 1), lambda i: labels[i + 1] IS NOT NULL AND labels[i + 1] <> -100 AND input_ids[i] = labels[i + 1])) AS correct,
  len(list_filter(range(1, greatest(len(labels), 1)), lambda i: labels[i + 1] IS NOT NULL AND labels[i + 1] <> -100)) AS counted
FROM encoded_rows WHERE input_ids IS NOT NULL AND labels IS NOT NULL""")
def token_accuracy(spark: SparkSession, root: str) -> DataFrame:
    """Ids taken as predictions of the next label: how many are right."""
    t = K.token_accuracy(_rows(spark, root), "row_id", "input_ids", "labels")
    return t.select(F.col("id").alias("row_id"), F.col("correct").cast("long").alias("correct"), F.col("counted").cast("long").alias("counted"))


@query("""
SELECT 'delete' AS strategy, count(*) AS n, coalesce(sum(len(input_ids)), 0)::BIGINT AS tokens FROM encoded_rows WHERE len(input_ids) <= 256
UNION ALL SELECT 'left', count(*), sum(CASE WHEN input_ids IS NOT NULL THEN least(len(input_ids), 256) END)::BIGINT FROM encoded_rows UNION ALL SELECT 'right', count(*), sum(CASE WHEN input_ids IS NOT NULL THEN least(len(input_ids), 256) END)::BIGINT FROM encoded_rows""")
def over_length(spark: SparkSession, root: str) -> DataFrame:
    """Rows and tokens that each way of handling over-long rows leaves."""
    made = [
        K.over_length(_rows(spark, root), "input_ids", 256, s).agg(F.lit(s).alias("strategy"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("input_ids")), F.lit(0)).alias("tokens"))
        for s in ("delete", "left", "right")
    ]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query(f"""
WITH t AS (SELECT row_id, unnest(input_ids) AS token, generate_subscripts(input_ids, 1) AS i FROM encoded_rows WHERE len(input_ids) > 0),
n AS (SELECT token, row_number() OVER (ORDER BY row_id, i) - 1 AS place FROM t),
b AS (SELECT place // 512 AS block_no, list(token ORDER BY place) AS tokens FROM n GROUP BY 1)
SELECT block_no, len(tokens) AS n, {_JOIN.format('tokens')} AS tokens_md5 FROM b WHERE block_no < (SELECT greatest(count(*) // 512, 1) FROM n)""")
def token_blocks(spark: SparkSession, root: str) -> DataFrame:
    """All token ids one after the other in blocks of 512."""
    b = K.fixed_blocks(_rows(spark, root), "row_id", "input_ids", 512)
    return b.select("block_no", F.size("tokens").cast("long").alias("n"), _text("tokens").alias("tokens_md5"))


@query(f"""
SELECT row_id, len(p) AS n_padded, {_JOIN.format('p[len(p) // 4 + 1 : len(p) // 2]')} AS rank1_md5, {_JOIN.format('list_concat(p[len(p) // 8 * 2 + 1 : len(p) // 8 * 3], p[len(p) // 8 * 5 + 1 : len(p) // 8 * 6])')} AS zigzag2_md5
FROM (SELECT row_id, list_concat(input_ids, list_transform(range((8 - len(input_ids) % 8) % 8), lambda i: 0)) AS p FROM encoded_rows WHERE input_ids IS NOT NULL)""")
def sequence_shards(spark: SparkSession, root: str) -> DataFrame:
    """Sequences padded to a multiple of 8 and split among four ranks, contiguously and in zigzag."""
    p = K.padded_to_multiple(F.col("input_ids"), 8, F.lit(0))
    rows = _rows(spark, root).where("input_ids IS NOT NULL").select("row_id", p.alias("p"))
    return rows.select("row_id", F.size("p").cast("long").alias("n_padded"), _text(K.rank_slice(F.col("p"), 4, 1)).alias("rank1_md5"), _text(K.zigzag(F.col("p"), 4, 2)).alias("zigzag2_md5"))


@query("""
WITH p AS (SELECT row_id, i - 1 AS i, ((i - 1) % 100)::INT AS pos FROM (SELECT row_id, unnest(range(1, len(input_ids) + 1)) AS i FROM encoded_rows WHERE len(input_ids) > 0)),
s AS (SELECT row_id, sum((pos = 0)::INT) OVER (PARTITION BY row_id ORDER BY i) AS seg FROM p),
c AS (SELECT row_id, seg, count(*) AS n FROM s GROUP BY ALL)
SELECT row_id, count(*) AS segments, max(n) AS longest FROM c GROUP BY row_id""")
def packed_segments(spark: SparkSession, root: str) -> DataFrame:
    """Segments of packed sequences, told by position ids that begin at 0 again."""
    positions = F.transform("input_ids", lambda _, i: i % 100)
    return _rows(spark, root).where(F.size("input_ids") > 0).select("row_id", K.segments_of(positions).alias("s")).select("row_id", F.size("s").cast("long").alias("segments"), F.array_max("s").cast("long").alias("longest"))


@query("""
SELECT row_id, list_transform(list_filter(range(len(input_ids) - 1), lambda i: input_ids[i + 1] = input_ids[1] AND input_ids[i + 2] = input_ids[2]), lambda i: i::INT) AS starts FROM encoded_rows WHERE len(input_ids) >= 2""")
def sub_array_positions(spark: SparkSession, root: str) -> DataFrame:
    """Every place where a row's first two tokens occur."""
    ids = F.col("input_ids")
    starts = F.filter(F.sequence(F.lit(0), F.size(ids) - 2), lambda i: (F.get(ids, i) == ids[0]) & (F.get(ids, i + 1) == ids[1]))
    return _rows(spark, root).where(F.size(ids) >= 2).select("row_id", starts.alias("starts"))


@query("""
SELECT row_id, len(list_filter(input_ids, lambda x: x < 1000)) AS below, len(list_filter(input_ids, lambda x: x <= 1000)) AS up_to,
  list_transform(range(5), lambda i: floor((i + 0.5::DOUBLE) * len(input_ids) / 5)::INT) AS picks
FROM encoded_rows WHERE len(input_ids) > 0""")
def bounds_and_uniform_indices(spark: SparkSession, root: str) -> DataFrame:
    """Binary-search bounds in the sorted ids, and five indices at the middles of equal gaps."""
    s = F.filter(F.array_sort("input_ids"), lambda x: x.isNotNull())
    return _rows(spark, root).where(F.size("input_ids") > 0).select(
        "row_id", A.lower_bound(s, F.lit(1000)).cast("long").alias("below"), A.upper_bound(s, F.lit(1000)).cast("long").alias("up_to"), A.uniform_indices(F.size("input_ids"), 5).alias("picks")
    )


@query("""
SELECT count(length) AS n, round(avg(length), 6) AS mean, round(stddev_pop(length), 6) AS std, min(length) AS least, max(length) AS most, sum(CASE WHEN input_ids IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing FROM encoded_rows""")
def length_stats(spark: SparkSession, root: str) -> DataFrame:
    """Mean, population deviation, least and largest length."""
    n = F.col("length")
    return _rows(spark, root).agg(
        F.count(n).alias("n"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_pop(n), 6).alias("std"), F.min(n).alias("least"), F.max(n).alias("most"), F.count_if(F.col("input_ids").isNull()).alias("missing")
    )


@query("""
WITH m AS (SELECT row_id, len(input_ids) // 2 AS mid FROM encoded_rows WHERE len(input_ids) > 2)
SELECT row_id, list_transform(range(len(input_ids)), lambda i: CASE WHEN i = mid THEN 103 ELSE coalesce(input_ids[i + 1], 0) END)[mid : mid + 2] AS near_mask,
  len(list_filter(input_ids, lambda x: x <> 0)) AS n_real FROM encoded_rows JOIN m USING (row_id)""")
def mask_and_padding(spark: SparkSession, root: str) -> DataFrame:
    """A mask in the middle of each row, its surroundings, and the tokens that are no padding."""
    ids = F.col("input_ids")
    at = F.floor(F.size(ids) / 2).cast("int")
    rows = _rows(spark, root).where(F.size(ids) > 2).select("row_id", at.alias("at"), ids)
    masked = F.transform("input_ids", lambda x, i: F.when(i == F.col("at"), 103).otherwise(F.coalesce(x, F.lit(0))))
    return rows.select("row_id", F.slice(masked, F.col("at"), F.lit(3)).alias("near_mask"), F.size(F.filter("input_ids", lambda x: x != 0)).cast("long").alias("n_real"))
