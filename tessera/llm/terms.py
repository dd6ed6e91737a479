"""Problem 5: occurrences and records of every distinct value or term.

Method: last-seen counters. Each task reads its records in order and holds, for every term, the number of
occurrences, the number of records and the last record that held it; a repeated term of one record is
recognised by that last record, so no set is built per record. A record lies in one task, so the partial
counters of the tasks add up; they are merged by a hash shuffle on the term, after Spark's own map-side
combine. A term that is in every record costs one row per task, whatever its frequency.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.runtime import spread, staged, table

#: A task's counters are emitted and begun anew at this many terms, which bounds its memory.
FLUSH_TERMS = 300_000
#: At most so many records hold a rare term; more than this share of all records with a term hold a common one.
RARE_RECORDS, COMMON_SHARE = 2, 0.25

# The blocks whose letters and digits are terms of their own.
WIDE = "぀-ヿ㐀-鿿"
TERM = re.compile(rf"(?=[{WIDE}])[^\W_]|(?:(?![{WIDE}])[^\W_])+")

_PARTIAL = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


class LastSeen:
    """Counters of terms that arrive ordered by record."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.occurrences: list[int] = []
        self.records: list[int] = []
        self.last: list[int] = []

    def add(self, terms: list, record: int) -> None:
        slot, occurrences, records, last = self.slot, self.occurrences, self.records, self.last
        for term in terms:
            at = slot.get(term)
            if at is None:
                slot[term] = len(last)
                occurrences.append(1)
                records.append(1)
                last.append(record)
            else:
                occurrences[at] += 1
                if last[at] != record:
                    records[at] += 1
                    last[at] = record

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([None if t is None else str(t) for t in self.slot], pa.string()), pa.array(self.occurrences, pa.int64()), pa.array(self.records, pa.int64())],
            schema=_PARTIAL,
        )


class LastSeenIntegers:
    """The same counters for integers, a batch at a time: terms in ascending order, each with its last record."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.terms, self.occurrences, self.records, self.last = (np.zeros(0, dtype=np.int64) for _ in range(4))

    def add(self, values: np.ndarray, record: np.ndarray) -> None:
        """``values`` in the order of their ``record``."""
        if not len(values):
            return
        order = np.argsort(values, kind="stable")  # by term, within it still by record
        values, record = values[order].astype(np.int64), record[order]
        starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        terms = values[starts]
        unseen = np.setdiff1d(terms, self.terms, assume_unique=True)
        if len(unseen):
            at = np.searchsorted(self.terms, unseen)
            self.terms = np.insert(self.terms, at, unseen)
            self.occurrences, self.records = (np.insert(x, at, 0) for x in (self.occurrences, self.records))
            self.last = np.insert(self.last, at, -1)
        slot = np.searchsorted(self.terms, terms)
        seen_before = np.r_[-1, record[:-1]]
        seen_before[starts] = self.last[slot]
        ends = np.r_[starts[1:], len(values)]
        self.occurrences[slot] += ends - starts
        self.records[slot] += np.add.reduceat((record != seen_before).astype(np.int64), starts)
        self.last[slot] = record[ends - 1]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pc.cast(pa.array(self.terms), pa.string()), pa.array(self.occurrences), pa.array(self.records)], schema=_PARTIAL)


def terms_of(text: str) -> list[str]:
    """The terms of one text, in order, with repetitions."""
    return TERM.findall(text.lower())


def _all_records(with_any: int) -> pa.RecordBatch:
    """The term NULL counts the records with any term."""
    return pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([with_any], pa.int64())], schema=_PARTIAL)


def _count_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column 0: arrays of integers."""
    counters, with_any, first = LastSeenIntegers(), 0, 0
    for batch in batches:
        lists = batch.column(0)
        flat = lists.flatten()
        keep = flat.is_valid().to_numpy(zero_copy_only=False)
        record = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[keep].astype(np.int64) + first
        counters.add(flat.fill_null(0).to_numpy(zero_copy_only=False)[keep], record)
        with_any += len(np.unique(record))
        first += batch.num_rows
        if len(counters.terms) > FLUSH_TERMS:
            yield counters.batch()
            counters.clear()
    yield counters.batch()
    yield _all_records(with_any)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column 0: arrays of texts."""
    counters, record, with_any = LastSeen(), 0, 0

    def flush() -> pa.RecordBatch:
        out = counters.batch()
        counters.clear()
        return out

    for batch in batches:
        for texts in batch.column(0).to_pylist():
            record += 1
            any_term = False
            for text in texts or ():
                if text and (terms := terms_of(text)):
                    counters.add(terms, record)
                    any_term = True
            with_any += any_term
            if len(counters.last) > FLUSH_TERMS:
                yield flush()
    if counters.last:
        yield flush()
    yield _all_records(with_any)


def _partials(df: DataFrame, column: str, field: str) -> DataFrame:
    kind = df.schema[column].dataType.simpleString()
    source = df.select(F.col(column).alias("v"))
    if kind == "string":
        source = source.select(F.array("v").alias("v"))
    elif kind.startswith("array<struct"):
        source = source.select(F.col("v.content").alias("v"))
    integers = kind in ("array<int>", "array<bigint>", "array<smallint>", "array<tinyint>")
    counted = spread(source).mapInArrow(_count_values if integers else _count_terms, "term string, occurrences long, records long")
    return counted.select(F.lit(field).alias("field"), "term", "occurrences", "records")


def term_frequency(*fields: tuple[DataFrame, str, str]) -> DataFrame:
    """Occurrences, records and mark of every value or term of each ``(table, column, field name)``.

    A column is an array of integers (its values are the terms), a string, an array of strings, or an array of
    structs with a field ``content`` (the terms of all texts of a row). A row is a record. Null rows, null
    elements and empty texts add nothing; a table without terms gives no rows; repeated rows count again;
    all other columns are ignored, whatever their names.

    Returns ``field, term, occurrences, records, all_records, mark``: ``all_records`` is the number of records
    that hold any term of the field, ``mark`` is 'rare' (at most 2 records), 'common' (more than a quarter of
    ``all_records``) or NULL. A term that would be both, in a table of few records, is 'rare'.
    """
    parts = [_partials(*f) for f in fields]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    summed = staged(union.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")))
    total = summed.where(F.col("term").isNull()).select("field", F.col("records").alias("all_records"))
    return (
        summed.where(F.col("term").isNotNull())
        .join(F.broadcast(total), "field")  # one row per field
        .withColumn("mark", F.when(F.col("records") <= RARE_RECORDS, "rare").when(F.col("records") > F.col("all_records") * COMMON_SHARE, "common"))
        .select("field", "term", "occurrences", "records", "all_records", "mark")
    )


def p5_terms(spark: SparkSession, root: str) -> DataFrame:
    """Every value of encoded_rows.input_ids and every term of chats.messages.content with its counts and mark."""
    return term_frequency((table(spark, root, "encoded_rows"), "input_ids", "input_ids"), (table(spark, root, "chats"), "messages", "content"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """The terms marked as too rare or too common."""
    return p5_terms(spark, root).where(F.col("mark").isNotNull()).select("field", "term", "mark")


# RE2 has no look-ahead: the letters and digits outside the wide blocks are what is no mark, punctuation,
# symbol, separator or other, and the wide ones are listed by range.
_SQL_TERM = (
    r"[\x{3041}-\x{3096}\x{309D}-\x{309F}\x{30A1}-\x{30FA}\x{30FC}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"
    r"|[^\p{M}\p{P}\p{S}\p{Z}\p{C}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]+"
).replace("\\\\", "\\")

_SQL_COUNTED = f"""
WITH said AS (
  SELECT 'input_ids' AS field, row_id AS rec, CAST(v AS VARCHAR) AS term
  FROM (SELECT row_id, unnest(input_ids) AS v FROM encoded_rows) WHERE v IS NOT NULL
  UNION ALL
  SELECT 'content', sample_id, unnest(regexp_extract_all(lower(m.content), '{_SQL_TERM}'))
  FROM (SELECT sample_id, unnest(messages) AS m FROM chats) WHERE m.content IS NOT NULL
), counted AS (
  SELECT field, term, count(*) AS occurrences, count(DISTINCT rec) AS records FROM said GROUP BY field, term
), total AS (
  SELECT field, count(DISTINCT rec) AS all_records FROM said GROUP BY field
), marked AS (
  SELECT field, term, occurrences, records, all_records,
         CASE WHEN records <= 2 THEN 'rare' WHEN records * 4 > all_records THEN 'common' END AS mark
  FROM counted JOIN total USING (field)
)
"""
SQL = {
    "p5_terms": _SQL_COUNTED + "SELECT * FROM marked",
    "p5_found": _SQL_COUNTED + "SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
}
