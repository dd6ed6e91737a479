"""Readers. Each takes a session and a path (or a table of raw lines) and gives a DataFrame; schemas are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

CHAT_SCHEMA = "messages array<struct<role:string,content:string>>"
BROKEN = "_broken_line"


def _ddl(schema: str | StructType) -> str:
    return schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def jsonl(spark: SparkSession, path: str, schema: str | StructType = CHAT_SCHEMA) -> DataFrame:
    """One JSON object a line; a malformed line fails the read."""
    return spark.read.schema(_ddl(schema)).option("mode", "FAILFAST").json(path)


def jsonl_tolerant(spark: SparkSession, path: str, schema: str | StructType = CHAT_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines as ``line``); blank lines are skipped."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return parsed_lines(lines, "line", schema)


def parsed_lines(df: DataFrame, column: str, schema: str | StructType = CHAT_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """Split a table of raw JSON lines into (rows with the parsed columns, rows that are malformed); blank ones are dropped.

    A line is malformed unless it is exactly one JSON object. Columns of ``df`` whose names clash with parsed ones
    give way to them.
    """
    ddl = _ddl(schema)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN, "allowSingleQuotes": "false"}
    whole = F.json_array_length(F.concat(F.lit("["), F.col(column), F.lit("]"))) == 1
    parsed = F.from_json(F.col(column), f"{ddl}, {BROKEN} string", options)
    rows = df.where(F.col(column).rlike(r"\S")).withColumn("_p", parsed).withColumn("_ok", F.coalesce(whole & F.col(column).rlike(r"^\s*\{") & F.col(f"_p.{BROKEN}").isNull() & F.col("_p").isNotNull(), F.lit(False)))
    names = [f.name for f in StructType.fromDDL(ddl)]
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    return rows.where("_ok").select(*kept, *[F.col(f"_p.{n}").alias(n) for n in names]), rows.where("NOT _ok").select(*df.columns)


def json_document(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """One JSON document a file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(_ddl(schema)) if schema else reader).json(path)


def by_category(spark: SparkSession, paths: str | list[str], schema: str, category: str = "category", exclude: tuple[str, ...] = ("answer", "result")) -> DataFrame:
    """JSONL files with a category: that of the row, else the file's stem. Files whose name holds an excluded word are left out."""
    rows = spark.read.schema(schema).json(paths).withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    for word in exclude:
        rows = rows.where(~F.col("_file").contains(word))
    stem = F.regexp_replace("_file", r"\.[^.]*$", "")
    return rows.withColumn(category, F.coalesce(category, stem)).drop("_file")


def prompts(sources: list[tuple[DataFrame, list[Column]]]) -> DataFrame:
    """``prompt`` from heterogeneous sources: the first non-NULL of each source's candidates (arrays: their first element); empty ones dropped."""
    parts = []
    for df, candidates in sources:
        plain = [F.get(c, F.lit(0)) if df.select(c.alias("c")).schema["c"].dataType.typeName() == "array" else c for c in candidates]
        parts.append(df.select(F.coalesce(*plain).alias("prompt")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p, allowMissingColumns=True)
    return union.where(F.coalesce(F.length(F.trim("prompt")), F.lit(0)) > 0)


def tsv(spark: SparkSession, path: str, columns: list[str], header: bool = True, quote: str = '"') -> DataFrame:
    """Tab-separated values as strings, with or without a byte order mark."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).option("sep", "\t").option("quote", quote).option("header", header).csv(path)
    return rows.withColumn(columns[0], F.regexp_replace(columns[0], "^﻿", ""))


def nli_pairs(rows: DataFrame, language: str, label_names: dict[str, str] | None = None) -> DataFrame:
    """``text_a, text_b, label`` of one language of a natural-language-inference table; label spellings are unified."""
    names = label_names or {"contradictory": "contradiction"}
    label = F.col("gold_label")
    for old, new in names.items():
        label = F.when(F.col("gold_label") == old, new).otherwise(label)
    return rows.where(F.col("language") == language).select(F.col("sentence1").alias("text_a"), F.col("sentence2").alias("text_b"), label.alias("label"))


def server_events(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Parsed JSON of server-sent event lines (``data: {...}``); blank lines and ``[DONE]`` are skipped."""
    body = F.btrim(F.regexp_replace(F.col(column), "^data:", ""))
    return df.where(F.col(column).startswith("data:")).select(body.alias("_b")).where("_b <> '' AND _b <> '[DONE]'").select(F.from_json("_b", schema).alias("e")).where("e IS NOT NULL").select("e.*")


def sample_cache(spark: SparkSession, paths: list[str], schema: str = "id string, choices array<string>") -> DataFrame:
    """``id, choices`` gathered from earlier outputs; folders that don't exist are skipped."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = [p for p in paths if hadoop.Path(p).getFileSystem(conf).exists(hadoop.Path(p))]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(found).groupBy("id").agg(F.flatten(F.collect_list("choices")).alias("choices"))


def scalar_log(df: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """``tag, step, value`` of a long table of scalars, optionally of some tags."""
    rows = df.select("tag", F.col("step").cast("long").alias("step"), F.col("value").cast("double").alias("value"))
    return rows.where(F.col("tag").isin(tags)) if tags else rows


def archives(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """``archive, name, line_no, line`` of the named members of zip archives, each archive read in one task."""
    import io
    import zipfile

    def lines(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for path_, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in names:
                            if name in z.namelist():
                                out += [(path_, name, i, line) for i, line in enumerate(z.read(name).decode("utf-8", "replace").splitlines())]
                except zipfile.BadZipFile:
                    continue
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()))], names=["archive", "name", "line_no", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lines, "archive string, name string, line_no long, line string")


def cached(spark: SparkSession, path: str, build, overwrite: bool = False) -> DataFrame:
    """The table at a path; built by ``build()`` and written there first if it is missing or to be overwritten."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    done = hadoop.Path(path, "_SUCCESS")
    if overwrite or not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def projected(df: DataFrame, fields: list[str]) -> DataFrame:
    """Only those of the fields that the table has, in the order given."""
    have = set(df.columns)
    return df.select(*[f for f in fields if f in have])


def rows_at(spark: SparkSession, path: str, numbers: list[int] | tuple[int, int]) -> DataFrame:
    """Rows of ``sinks.indexed`` by number: a list of numbers, or a pair for a range from the first up to before the second.

    Only files and row groups that may hold them are read.
    """
    rows = spark.read.parquet(path)
    no = F.col("row_no")
    return rows.where((no >= numbers[0]) & (no < numbers[1])) if isinstance(numbers, tuple) else rows.where(no.isin(list(numbers)))
