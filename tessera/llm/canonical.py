"""Problem 3: records that are equal apart from how they are written.

Method: every record gets a canonical key (a 128-bit digest of its canonical form). Keys are counted exactly by partial
counts per task, merged by key in one shuffle of a few bytes a record; these counts show which keys are hot (HOT_ROWS
rows or more, and at most HOT_KEYS keys, whatever the number of records). Hot keys are aggregated in two levels, salted by
identifier; the rest in one. The representative of a group is its smallest id. Where each record has to meet its
representative, hot keys are salted again, so that no task holds more rows of one key than the bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.runtime import hot_bound, salted_join, staged, table

#: A key with so many rows is hot, unless there are more than HOT_KEYS such keys: then the bound is doubled until there aren't.
HOT_ROWS, HOT_KEYS = 1000, 100_000

LINE_SCHEMA = "messages array<struct<role string, content string>>, source string, channel string, lang string, _broken string"

# Separators of the canonical form; they are no letters or digits, so no content holds them after folding
# except between two digits, where a backslash is put before them.
_NULL, _FIELD, _ROW = "\u0000", "\u0001", "\u0002"


def folded(text: Column) -> Column:
    """``text`` without letter case, whitespace and punctuation, except for what stands between two digits.

    Case is folded by upper and then lower case, 'ß' equals 'SS' and a final sigma any sigma. Between
    two digits a run of whitespace is one space. NULL stays NULL; a text without letters and digits becomes ''.
    """
    plain = F.replace(F.translate(F.lower(F.upper(text)), "ς", "σ"), F.lit("ß"), F.lit("ss"))
    # Possessive runs that begin right after a letter, a digit or the start: a run is taken whole or not at all.
    plain = F.regexp_replace(plain, r"(?:(?<=\p{L})|\A)[^\p{L}\p{N}]++|(?<=\p{N})[^\p{L}\p{N}]++(?!\p{N})", "")
    plain = F.regexp_replace(plain, r"(?U)\s+", " ")
    return F.regexp_replace(plain, r"([\x00-\x02\\])", r"\\$1")


def conversation_form(messages: Column) -> Column:
    """The canonical form of a list of messages: roles as they are, contents folded, NULL apart from ''."""
    return F.array_join(
        F.transform(messages, lambda m: F.concat(F.coalesce(m["role"], F.lit(_NULL)), F.lit(_FIELD), F.coalesce(folded(m["content"]), F.lit(_NULL)))),
        _ROW,
    )


def _key(form: Column) -> Column:
    return F.unhex(F.md5(form))


def chat_records(df: DataFrame, id_column: str = "sample_id", messages: str = "messages") -> DataFrame:
    """``id, key`` of each row whose messages are neither NULL nor empty."""
    return df.where(F.size(messages) > 0).select(F.col(id_column).alias("id"), _key(conversation_form(F.col(messages))).alias("key"))


def line_records(df: DataFrame, id_column: str = "line_id", raw: str = "raw") -> DataFrame:
    """``id, key`` of each JSON line that is valid; besides messages also source, channel and lang count."""
    strict = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "allowSingleQuotes": "false"}
    parsed = df.where(F.expr(f"json_array_length(concat('[', `{raw}`, ']')) = 1 AND `{raw}` RLIKE '^\\\\s*\\\\{{'")).select(
        F.col(id_column).alias("id"), F.from_json(raw, LINE_SCHEMA, strict).alias("r")
    )
    parts = [F.coalesce(F.col(f"r.{c}"), F.lit(_NULL)) for c in ("source", "channel", "lang")]
    form = F.concat_ws("\u0003", *parts, F.coalesce(conversation_form(F.col("r.messages")), F.lit(_NULL)))
    return parsed.where("r IS NOT NULL AND r._broken IS NULL").select("id", _key(form).alias("key"))


class Copies:
    """The groups of equal records of ``records (id, key)``. All frames are staged tables of some bytes a record."""

    def __init__(self, records: DataFrame) -> None:
        self.records = staged(records)  # read several times below instead of canonicalising again
        counted = staged(self.records.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("keep_id")))
        self.bound = hot_bound(counted, "copies", HOT_ROWS, HOT_KEYS)
        rest = counted.where(F.col("copies") < self.bound)
        hot_keys = counted.where(F.col("copies") >= self.bound).select("key", F.ceil(F.col("copies") / self.bound).cast("int").alias("salts"))
        hot = self.records.join(F.broadcast(hot_keys), "key")  # at most HOT_KEYS keys
        first_level = hot.groupBy("key", F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt")).agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("keep_id"))
        second_level = first_level.groupBy("key").agg(F.sum("copies").alias("copies"), F.min("keep_id").alias("keep_id"))
        #: ``key, copies, keep_id``: one row for each distinct record.
        self.groups = rest.unionByName(second_level)

    def collapsed(self) -> DataFrame:
        """``keep_id, copies`` of each group. ``keep_id`` is NULL only where all ids of the group are."""
        return self.groups.select("keep_id", "copies")

    def placed(self, groups: DataFrame) -> DataFrame:
        """``keep_id, id, copies`` of every row of some groups."""
        return salted_join(self.records, groups.withColumn("n", F.col("copies")), ["key"], "n", F.col("id"), self.bound).select("keep_id", "id", "copies")


def grouped_copies(records: DataFrame) -> DataFrame:
    """``keep_id, id, copies`` of every record of ``records (id, key)``.

    ``keep_id`` is the smallest id with the same key, ``copies`` how many rows hold the key (1: no copy). Rows
    with the same id count each. Rows whose id is NULL count as copies, but represent a group only if all its
    ids are NULL. An empty table gives no rows.
    """
    copies = Copies(records)
    return copies.placed(copies.groups)


def collapsed(records: DataFrame) -> DataFrame:
    """``keep_id, copies``: one row for each distinct record, as in ``grouped_copies``; no row meets another but by aggregation."""
    return Copies(records).collapsed()


def repeated(records: DataFrame) -> DataFrame:
    """``keep_id, id, copies`` of the records that repeat one with a smaller id."""
    copies = Copies(records)
    return copies.placed(copies.groups.where("copies > 1")).where("id > keep_id")


def _both(spark: SparkSession, root: str) -> list[tuple[str, DataFrame]]:
    return [("chats", chat_records(table(spark, root, "chats"))), ("raw_lines", line_records(table(spark, root, "raw_lines")))]


def p3_collapsed(spark: SparkSession, root: str) -> DataFrame:
    """One row for each distinct record of chats and raw_lines: its smallest id and its number of copies."""
    parts = [collapsed(d).select(F.lit(t).alias("tab"), "keep_id", "copies") for t, d in _both(spark, root)]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Each record that repeats another one, beside the one to keep."""
    parts = [repeated(d).select(F.lit(t).alias("tab"), "keep_id", F.col("id").alias("copy_id")) for t, d in _both(spark, root)]
    return parts[0].unionByName(parts[1])


# DuckDB folds one character at a time: RE2 has no look-around, so digits are set off by marks first.
def _sql_fold(x: str) -> str:
    """Keep what stands between digits: every run between two digits becomes §run¤ first, all else is dropped."""
    lower = f"replace(lower(replace(upper({x}), 'ß', 'SS')), 'ς', 'σ')"
    # twice, since neighbouring matches share a digit
    marked = lower
    for _ in range(2):
        marked = rf"regexp_replace({marked}, '(\p{{N}})([^\p{{L}}\p{{N}}\x01\x02]+)(\p{{N}})', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g')"
    # inside the marks whitespace runs are one space; outside of them only letters and digits stay
    return (
        "list_aggregate(list_transform(string_split(" + marked + ", chr(1)), lambda part, i: CASE WHEN i = 1 THEN "
        r"regexp_replace(part, '[^\p{L}\p{N}]+', '', 'g') ELSE "
        r"regexp_replace(split_part(part, chr(2), 1), '[\s\p{Z}\x0b\x{85}]+', ' ', 'g') || chr(2) || "
        r"regexp_replace(split_part(part, chr(2), 2), '[^\p{L}\p{N}]+', '', 'g') END), 'string_agg', chr(1))"
    )


_SQL_MESSAGES = f"list_transform(%s, lambda m: struct_pack(r := m.role, c := {_sql_fold('m.content')}))::VARCHAR"
_SQL_GROUPED = f"""
WITH chat AS (
  SELECT 'chats' AS tab, sample_id AS id, {_SQL_MESSAGES % 'messages'} AS form FROM chats WHERE len(messages) > 0
), line AS (
  SELECT 'raw_lines' AS tab, line_id AS id,
         struct_pack(s := raw->>'source', c := raw->>'channel', l := raw->>'lang', m := {_SQL_MESSAGES % "from_json(raw->'messages', '[{\"role\":\"VARCHAR\",\"content\":\"VARCHAR\"}]')"})::VARCHAR AS form
  FROM raw_lines WHERE json_valid(raw)
), grouped AS (
  SELECT tab, id, min(id) OVER (PARTITION BY tab, form) AS keep_id, count(*) OVER (PARTITION BY tab, form) AS copies
  FROM (SELECT * FROM chat UNION ALL SELECT * FROM line)
)
"""
SQL = {
    "p3_collapsed": _SQL_GROUPED + "SELECT tab, keep_id, copies FROM grouped WHERE id = keep_id",
    "p3_found": _SQL_GROUPED + "SELECT tab, keep_id, id AS copy_id FROM grouped WHERE id > keep_id",
}
