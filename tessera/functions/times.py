"""Times as they appear in logs, prompts and file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 with their fraction."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def file_stamp(ts: Column) -> Column:
    """``v20250131-235959``-like stamps without the prefix."""
    return F.date_format(ts, "yyyyMMdd-HHmmss")


def prompt_date(ts: Column) -> Column:
    """``31 Jan 2025``."""
    return F.date_format(ts, "dd MMM yyyy")


def remaining(done: Column, total: Column, elapsed_s: Column) -> Column:
    """Struct of ``percentage`` (2 digits), ``elapsed`` and ``remaining`` as texts, at the pace so far; NULL before any progress."""
    left = F.try_divide(elapsed_s * (total - done), done)
    return F.struct(F.concat(F.round(F.try_divide(100 * done, total), 2).cast("string"), F.lit("%")).alias("percentage"), short_duration(elapsed_s).alias("elapsed"), short_duration(left).alias("remaining"))


def short_duration(seconds: Column) -> Column:
    """``1d 2h 3m 4s``, leaving out leading zero parts."""
    s = F.round(seconds).cast("long")
    parts = [(F.floor(s / 86_400), "d"), (F.floor(F.pmod(s, F.lit(86_400)) / 3600), "h"), (F.floor(F.pmod(s, F.lit(3600)) / 60), "m")]
    shown, seen = [], F.lit(False)
    for value, unit in parts:
        seen = seen | (value > 0)
        shown.append(F.when(seen, F.concat(value.cast("string"), F.lit(unit))))
    return F.when(s.isNotNull(), F.concat_ws(" ", *shown, F.concat(F.pmod(s, F.lit(60)).cast("string"), F.lit("s"))))
