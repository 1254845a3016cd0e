"""Chats, event logs and wiki pages as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import fold

LOOKBACK_DAYS, OVERLAP_DAYS = 90, 1


def window_start(last_ingest: Column, as_of: Column) -> Column:
    """From when a scan reads: a day before the last one, else 90 days back."""
    day = F.expr(f"make_dt_interval({OVERLAP_DAYS})")
    return F.coalesce(last_ingest - day, as_of - F.expr(f"make_dt_interval({LOOKBACK_DAYS})"))


def threads(rows: DataFrame, key: str, order: str, who: str, text: str) -> DataFrame:
    """key, content, author, n of each thread: its messages in order, ``who: text`` by line; the author is the first."""
    m = F.struct(F.col(order).alias("o"), F.coalesce(F.col(who), F.lit("")).alias("w"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    out = rows.groupBy(key).agg(F.sort_array(F.collect_list(m)).alias("m"))
    lines = F.array_join(F.transform("m", lambda x: F.concat(x["w"], F.lit(": "), x["t"], F.lit("\n"))), "")
    return out.select(key, lines.alias("content"), F.col("m")[0]["w"].alias("author"), F.size("m").cast("long").alias("n"))


def daily(rows: DataFrame, ts: str, who: str, text: str, order: str) -> DataFrame:
    """day, content, n, last of each UTC day. Days are cut by the hour first, so that a day's lines are gathered in parts."""
    day = F.date_format(ts, "yyyy-MM-dd")
    line = F.concat(F.date_format(ts, "HH:mm:ss"), F.lit(" "), F.coalesce(F.col(who), F.lit("")), F.lit(": "), F.coalesce(F.col(text), F.lit("")), F.lit("\n"))
    m = F.struct(F.col(ts).alias("t"), F.col(order).alias("o"), line.alias("line"))
    parts = rows.groupBy(day.alias("day"), F.date_trunc("hour", ts).alias("hour")).agg(F.sort_array(F.collect_list(m)).alias("m"), F.count("*").alias("n"), F.max(ts).alias("last"))
    parts = parts.select("day", "hour", F.array_join(F.transform("m", lambda x: x["line"]), "").alias("part"), "n", "last")
    out = parts.groupBy("day").agg(F.sort_array(F.collect_list(F.struct("hour", "part"))).alias("p"), F.sum("n").alias("n"), F.max("last").alias("last"))
    return out.select("day", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("content"), "n", "last")


def thread_parts(rows: DataFrame, key: str, order: str, who: str, text: str, size: int = 1 << 20) -> DataFrame:
    """key, part, content, n of each thread as ``threads`` writes it, in parts of bounded size, for threads that no row holds."""
    line = F.concat(F.coalesce(F.col(who), F.lit("")), F.lit(": "), F.coalesce(F.col(text), F.lit("")), F.lit("\n"))
    return fold.documents(rows, key, [order], line, size)


def daily_parts(rows: DataFrame, ts: str, who: str, text: str, order: str, size: int = 1 << 20) -> DataFrame:
    """day, part, content, n of each UTC day as ``daily`` writes it, in parts of bounded size, for days that no row holds."""
    line = F.concat(F.date_format(ts, "HH:mm:ss"), F.lit(" "), F.coalesce(F.col(who), F.lit("")), F.lit(": "), F.coalesce(F.col(text), F.lit("")), F.lit("\n"))
    return fold.documents(rows.withColumn("day", F.date_format(ts, "yyyy-MM-dd")), "day", [ts, order], line, size)


def wiki_time(text: Column) -> Column:
    """A page's time in any of its three formats."""
    formats = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXX", "yyyy-MM-dd'T'HH:mm:ssXX")
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def chat_time(ts: Column) -> Column:
    """The time of a ``seconds.fraction`` stamp, null for another text."""
    return F.timestamp_seconds(F.split(ts, r"\.")[0].try_cast("bigint"))


def pdf_time(text: Column) -> Column:
    """The time of a ``D:YYYYMMDDHHmmSS`` stamp with what parts it has."""
    digits = F.regexp_extract(text, r"^(?:D:)?(\d{4,14})", 1)
    return F.when(F.length(digits) >= 4, F.try_to_timestamp(F.concat(digits, F.substring(F.lit("00000101000000"), F.length(digits) + 1, 14)), F.lit("yyyyMMddHHmmss")))
