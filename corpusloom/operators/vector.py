"""Vector search: exact nearest neighbours by L2 distance, filtered search, topic blending.

Queries are taken in blocks of bounded size. A block is sent to the tasks as a matrix; each task keeps the best k of its rows
for each query while it reads, so what is exchanged is k rows a query and task, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_BYTES = 32 << 20
#: Distances that are held at once.
TILE = 2_000_000
DIGITS = 6


def normalise(v: Column) -> Column:
    """A vector of length 1; a zero vector as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 1e-12, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)


def blend(a: Column, b: Column, weight: float = 0.3) -> Column:
    """The direction of a + weight * b, over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return normalise(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") + F.lit(weight) * y.cast("double")))


def _best(held: list, worst: np.ndarray, ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int, digits: int) -> None:
    """Bring the k best (ids, distances) of each query up to date, by distance to so many digits, then id. Only queries for which a row
    comes as near as their k-th best are looked at, so most batches cost one matrix product."""
    near = (queries**2).sum(1)[:, None] + (vectors**2).sum(1)[None] - 2 * queries @ vectors.T
    for q in np.flatnonzero(near.min(axis=1) <= worst + 1e-4).tolist():
        row = near[q]
        least = min(worst[q], np.partition(row, k - 1)[k - 1]) if len(row) > k else worst[q]
        at = np.flatnonzero(row <= least + 1e-4)
        d = np.sqrt(((vectors[at] - queries[q]) ** 2).sum(1))
        i, d = np.concatenate([held[q][0], ids[at]]), np.concatenate([held[q][1], d])
        order = np.lexsort((i, np.round(d, digits)))[:k]
        held[q] = (i[order], d[order])
        if len(order) == k:
            worst[q] = (d[order[-1]] + 10.0**-digits) ** 2


def knn(vectors: DataFrame, queries: DataFrame, k: int, *, vec_id: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", block_bytes: int = BLOCK_BYTES, digits: int = DIGITS) -> DataFrame:
    """query_id, vec_id, distance (rounded to ``digits``), rank of the k nearest vectors of each query. Rows of a null
    vector, or of another dimension than the query, are no neighbours."""
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).alias("v"))
    size = asked.agg(F.sum(F.size("v")).alias("n")).first()["n"] or 0
    n_blocks = int(8 * size // block_bytes) + 1
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    found: DataFrame | None = None
    for b in range(n_blocks):
        block = asked if n_blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b)
        got = [(r["query_id"], r["v"]) for r in block.collect()]
        by_dim: dict[int, list] = {}
        for q, v in got:
            by_dim.setdefault(len(v), []).append((q, v))
        sent = vectors.sparkSession.sparkContext.broadcast({d: (np.array([q for q, _ in x]), np.array([v for _, v in x], float)) for d, x in by_dim.items()})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            held = {d: [(np.zeros(0, np.int64), np.zeros(0))] * len(q) for d, (q, _) in asked.items()}
            worst = {d: np.full(len(q), np.inf) for d, (q, _) in asked.items()}
            for batch in batches:
                ids, column = batch.column(0).to_numpy(), batch.column(1)
                sizes = np.diff(column.offsets.to_numpy())
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
                starts = np.cumsum(sizes) - sizes
                for d, (_, q) in asked.items():
                    at = np.flatnonzero(sizes == d)
                    step = max(64, TILE // max(1, len(q)))
                    for i in range(0, len(at), step):
                        part = at[i : i + step]
                        _best(held[d], worst[d], ids[part], flat[starts[part][:, None] + np.arange(d)], q, k, digits)
            for d, (names, _) in asked.items():
                for name, (i, dist) in zip(names.tolist(), held[d], strict=True):
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), name)), pa.array(i), pa.array(dist)], ["query_id", "vec_id", "distance"])

        part = rows.mapInArrow(run, "query_id long, vec_id long, distance double")
        found = part if found is None else found.unionByName(part)
    ranked = found.withColumn("distance", F.round("distance", digits))
    by = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return ranked.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)


def knn_filtered(vectors: DataFrame, queries: DataFrame, k: int, keep: Column | DataFrame, *, exact: bool = False, **names) -> DataFrame:
    """The k nearest rows that ``keep``: a condition on rows of vectors, or a table of vec_id. The filter is applied to the max(5 k, 50)
    nearest of all rows, and may leave fewer than k; ``exact`` filters first."""
    vec_id = names.get("vec_id", "vec_id")
    ids = keep if isinstance(keep, DataFrame) else vectors.where(keep).select(F.col(vec_id).alias("vec_id"))
    if exact:
        return knn(vectors.join(ids.select(F.col("vec_id").alias(vec_id)), vec_id, "left_semi") if isinstance(keep, DataFrame) else vectors.where(keep), queries, k, **names)
    near = knn(vectors, queries, max(5 * k, 50), **names)
    kept = near.join(ids.distinct(), "vec_id", "left_semi")
    by = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return kept.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)
