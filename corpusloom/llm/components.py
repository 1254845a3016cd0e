"""Connected components of a table of links, by alternating large and small stars.

Each round replaces every node's links to larger neighbours (large star) or to smaller ones (small star) by links to
the least node it knows, until nothing changes: about log^2 of the longest path many rounds. Least neighbours are an
aggregation with partial sums and come back by a join, so a node with very many links is not gathered in one task.
Rounds are cut by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007).alias("h")).first()
    return r["n"], r["h"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a < b. The star of each node over the neighbours of one side."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node that is not a root, of edges(a, b)."""
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = materialise(edges, "links")
    mark = _mark(edges)
    while mark[0]:
        edges = materialise(_star(_star(edges, True), False), "links")
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
