"""Reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 60
DIGITS = 12


def fuse(ranked: DataFrame, limit: int | None = None, *, query_id: str = "query_id", item: str = "doc_id", rank: str = "rank") -> DataFrame:
    """query_id, item, score, rank: the sum of 1 / (60 + rank) over the lists that hold an item (rank from 1)."""
    score = F.round(F.sum(1.0 / (K + F.col(rank))), DIGITS)
    out = ranked.groupBy(query_id, item).agg(score.alias("score"))
    by = Window.partitionBy(query_id).orderBy(F.col("score").desc(), item)
    out = out.withColumn("rank", F.row_number().over(by).cast("long"))
    return out if limit is None else out.where(F.col("rank") <= limit)


def distinct_in_order(ranked: DataFrame, limit: int, *, query_id: str = "query_id", item: str = "doc_id", order: list[str] = ("list_id", "rank")) -> DataFrame:
    """The first ``limit`` different items of concatenated lists, each at its first place."""
    first = ranked.groupBy(query_id, item).agg(F.min(F.struct(*order)).alias("place"))
    by = Window.partitionBy(query_id).orderBy("place", item)
    return first.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= limit).select(query_id, item, "rank")
