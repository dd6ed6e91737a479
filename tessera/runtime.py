"""Session and staging helpers shared by every operator."""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def is_local(master: str) -> bool:
    """Whether driver and executors are one process on one machine."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Where the setting is absent, a temporary one on this machine, but only if this machine is the whole cluster: else
    every executor would write to a disk of its own and what is read back would be a part of the result.
    """
    configured = spark.sparkContext.getConf().get(CHECKPOINT_KEY, None) or spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    chosen = spark.sparkContext.getCheckpointDir()
    if chosen is None:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
        chosen = spark.sparkContext.getCheckpointDir()
    return chosen.rstrip("/")


_written: list[str] = []


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder of this session in the shared one; ``clear`` removes it."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Remove what this session's operators wrote to the shared folder. Frames that read it can't be used any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = hadoop.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _leave() -> None:
    """At the end of the program, what lies in a file system of this machine."""
    for path in _written:
        if path.startswith(("file:", "/")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)


def staged(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` once as Parquet in the shared folder and read it back.

    Unlike a cache it survives the loss of executors, unlike ``localCheckpoint`` it has no single copy, and
    later scans of it prune columns and know its true size.
    """
    spark = df.sparkSession
    path = scratch(spark, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, which reads tables without a shuffle, in at least as many partitions as there are cores.

    Only a table with fewer splits than cores is moved, that is a small one; a large one is read where it lies. The
    number of splits follows from the files, so no job runs.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # a frame with an exchange has its partitions from there; asking its RDD for them would run its stages
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.collectLeaves().size() != 1 or not _scans_only(plan):
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _scans_only(plan) -> bool:
    """Whether a logical plan is projections and filters over one leaf."""
    while plan.children().size():
        if plan.nodeName() not in ("Project", "Filter", "SubqueryAlias", "Generate", "Union") or plan.children().size() != 1:
            return False
        plan = plan.children().apply(0)
    return True


#: Rows of one key that a task may hold in a salted join, and hot keys that are broadcast at most.
HOT_ROWS, HOT_KEYS = 1000, 100_000


def hot_bound(counts: DataFrame, n: str = "n", least: int | None = None, most_keys: int | None = None) -> int:
    """The least bound, ``least`` times a power of two, that at most ``most_keys`` rows of ``counts`` reach.

    Rows are counted by magnitude, so a few dozen numbers come to the driver, whatever the number of keys. Since keys with
    k rows each are at most (all rows / k), the bound stays below 2 * all rows / most_keys.
    """
    least, most_keys = least or HOT_ROWS, most_keys or HOT_KEYS
    power = F.floor(F.log2(F.col(n) / F.lit(least)) + 1e-9).cast("int")
    steps = {r["power"]: r["keys"] for r in counts.where(F.col(n) >= least).groupBy(power.alias("power")).agg(F.count(F.lit(1)).alias("keys")).collect()}
    chosen = max(steps, default=0) + 1
    total = 0
    while chosen > 0 and total + steps.get(chosen - 1, 0) <= most_keys:
        chosen -= 1
        total += steps.get(chosen, 0)
    return least * 2**chosen


def salted_join(rows: DataFrame, one_each: DataFrame, keys: list[str], n: str, salt: Column, bound: int | None = None) -> DataFrame:
    """``rows`` joined with ``one_each``, which has one row (or few) a key and in ``n`` how many of ``rows`` hold the key (dropped).

    A key with ``bound`` rows or more is dealt by ``salt`` into parts of about that many, and its row of ``one_each`` is
    given to each part. Only those keys are broadcast, at most HOT_KEYS; everything is one join in one shuffle.
    """
    bound = bound or hot_bound(one_each, n)
    parts = F.ceil(F.col(n) / F.lit(bound)).cast("int")
    hot = one_each.where(F.col(n) >= bound).select(*keys, (parts + 1).alias("_parts")).distinct()
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(salt), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    given = one_each.withColumn("_salt", F.explode(F.when(F.col(n) >= bound, F.sequence(F.lit(0), parts)).otherwise(F.array(F.lit(0))))).drop(n)
    return dealt.join(given, [*keys, "_salt"]).drop("_salt")


def broadcast_object(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast ``value`` with its classes, which the executors may lack; read it with ``received``."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast) -> object:
    return pickle.loads(shared.value)
