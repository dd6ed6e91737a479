"""Streams over tables of files, drained to the end and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.runtime import scratch


def table_stream(spark: SparkSession, root: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{root}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{root}/{name[:-1]}[{name[-1]}].parquet")  # a pattern: it may be a folder or one file


def jsonl_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON lines as a stream; malformed lines become rows of NULLs."""
    return spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(path)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything that is there and read its output from the shared folder.

    In 'append' mode the file sink with its log of commits makes every row come out exactly once, whatever fails and
    is run again. In 'complete' and 'update' mode each batch writes a folder of its own number, so that a repeated
    batch overwrites itself; complete: the last batch is the result.
    """
    spark = stream.sparkSession
    base = scratch(spark, "stream")
    schema = stream.schema
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/log").trigger(availableNow=True)
    last = [-1]
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
            last[0] = max(last[0], number)

        query = writer.foreachBatch(write).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(schema).parquet(f"{base}/out")
    if last[0] < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/out/batch={last[0]}") if mode == "complete" else spark.read.parquet(f"{base}/out")


def shuffled_batches(stream: DataFrame, id_column: str, seed: int) -> DataFrame:
    """A stream drained in batches, each written in random order: shuffling with a buffer of one batch."""
    from pyspark.sql import functions as F

    from tessera.operators.sampling import shuffled_order

    spark = stream.sparkSession
    base = scratch(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).orderBy(shuffled_order(id_column, seed)).write.mode("overwrite").parquet(f"{base}/out/{number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out/*")


def cyclic(spark: SparkSession, df: DataFrame, id_column: str, rows_per_second: int = 100) -> DataFrame:
    """A table repeated for ever as a stream: ticks of a rate source joined to its numbered rows."""
    from pyspark.sql import functions as F

    from tessera.operators.sampling import numbered

    total = df.count()
    rows = numbered(df, id_column).withColumnRenamed("row_no", "_n")
    ticks = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select((F.pmod("value", F.lit(total))).alias("_n"), F.floor(F.col("value") / total).alias("round"))
    return ticks.join(rows, "_n").drop("_n")
