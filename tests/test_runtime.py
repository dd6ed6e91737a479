import pytest
from pyspark.sql import functions as F

from tessera import runtime as R


def test_salted_join_deals_hot_keys(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "warm").otherwise((F.col("id") % 700).cast("string")).alias("key"))
    groups = rows.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    want = {(r["id"], r["key"], r["least"]) for r in rows.join(groups.drop("n"), "key").collect()}
    for bound in (None, 50, 10**6):
        got = [(r["id"], r["key"], r["least"]) for r in R.salted_join(rows, groups, ["key"], "n", F.col("id"), bound).collect()]
        assert len(got) == 5000 and set(got) == want
    assert R.salted_join(rows.limit(0), groups.limit(0), ["key"], "n", F.col("id")).count() == 0


def test_hot_bound_keeps_the_broadcast_small(spark):
    counts = spark.range(1000).select((F.col("id") + 1).alias("n"))
    assert R.hot_bound(counts, least=10, most_keys=5000) == 10
    assert R.hot_bound(counts, least=10, most_keys=500) == 640 and R.hot_bound(counts, least=10, most_keys=1) == 1280
    assert R.hot_bound(counts.limit(0), least=10) == 10


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    assert R.is_local("local") and R.is_local("local[4]") and not R.is_local("local-cluster[3,2,1024]") and not R.is_local("spark://host:7077")

    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        R.shared_dir(Session)


def test_spread_moves_small_scans_only(spark, tmp_path):
    spark.range(50).coalesce(1).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert R.spread(scan.where("id > 3").select((F.col("id") + 1).alias("x"))).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    grouped = scan.groupBy("id").count()
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    assert R.spread(grouped) is grouped and spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
