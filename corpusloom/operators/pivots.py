"""Exact nearest neighbours over an index that says what need not be read.

A few vectors are pivots. Every vector is stored with its nearest pivot (its cell) and its distance r to it, by cells and sorted by r. For a query at
distance d from a pivot, a vector of the cell is at least |d - r| away, so within a bound u only d - u <= r <= d + u can matter. The bound comes
from the query's nearest cell, which is searched first: its k-th best distance there. Then the other cells are read in the ranges that some
query needs, by conditions that reach Parquet's statistics, and each query looks at its own range only. Nothing is left out: the results are
those of ``vector.knn`` for vectors of the index's dimension.

Pivots are chosen on the driver from at most SAMPLE vectors (those of least hash), far apart; they decide costs only. Every vector is indexed. Null vectors
and those of another dimension are no neighbours. Equal vectors are dealt by id too, so a crowded cell is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import fresh_folder
from . import vector as exact
from .cluster import _gaps, _matrix

SAMPLE, PIVOTS = 4096, 64
_ROW = "vec_id long, v array<double>, c int, r double, cell int"


@dataclass(frozen=True)
class Index:
    path: str
    pivots: np.ndarray
    least: np.ndarray  # r of each cell's nearest and farthest vector
    most: np.ndarray

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_ROW).parquet(self.path)


def build(vectors: DataFrame, to: str, *, pivots: int = PIVOTS, dim: int | None = None, vec_id: str = "vec_id", vector: str = "embedding", parts: int | None = None) -> Index:
    """Store the vectors of a dimension (the commonest, if it is not given) at ``to``."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    if dim is None:
        first = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").first()
        dim = first["d"] if first else 1
    rows = rows.where(F.size("v") == dim)
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).collect()], float).reshape(-1, dim)
    chosen = _apart(sample, pivots)
    sent = spark.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, gap = _gaps(_matrix(batch.column(1)), sent.value)
                c = pa.array(cell.astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.list_(pa.float64())), c, pa.array(np.sqrt(gap)), c], [x.split()[0] for x in _ROW.split(", ")])

    placed = rows.mapInArrow(run, _ROW)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed.repartitionByRange(n, "cell", "r", "vec_id").sortWithinPartitions("cell", "r", "vec_id").write.partitionBy("cell").parquet(to)
    least, most = np.full(len(chosen), np.inf), np.full(len(chosen), -np.inf)
    for r in spark.read.schema(_ROW).parquet(to).groupBy("cell").agg(F.min("r").alias("a"), F.max("r").alias("b")).collect():
        least[r["cell"]], most[r["cell"]] = r["a"], r["b"]
    return Index(to, chosen, least, most)


def _apart(sample: np.ndarray, n: int) -> np.ndarray:
    """At most n of the sample, each the farthest from those before."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    out, gap = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(out) < n and gap.max() > 0:
        out.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[out[-1]]) ** 2).sum(1))
    return sample[out]


def _search(index: Index, spark: SparkSession, ids: np.ndarray, asked: np.ndarray, plan: dict[int, list[tuple[int, float, float]]], bound: np.ndarray, k: int, told: dict | None) -> DataFrame:
    """query_id, vec_id, distance: the best k of each task for each query. plan: of each cell, (query, least r, most r)."""
    where = F.lit(False)
    for cell, wants in sorted(plan.items()):
        low, high = min(a for _, a, _ in wants), max(b for _, _, b in wants)
        where = where | ((F.col("c") == cell) & (F.col("r") >= float(low)) & (F.col("r") <= float(high)))
    rows = index.rows(spark).where(F.col("cell").isin(sorted(plan))).where(where)
    if told is not None:
        told["rows"] = told.get("rows", 0) + rows.count()
    sent = spark.sparkContext.broadcast((ids, asked, plan, bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, plan, bound = sent.value
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        worst = bound.copy()
        for batch in batches:
            if not batch.num_rows:
                continue
            names, points, cells, radius = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            order = np.lexsort((radius, cells))
            edges = np.flatnonzero(np.diff(cells[order], prepend=-1, append=-1))
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                some = order[low:high]
                for q, a, b in plan.get(int(cells[some[0]]), ()):
                    i, j = np.searchsorted(radius[some], a, "left"), np.searchsorted(radius[some], b, "right")
                    at = some[i:j]
                    if not len(at):
                        continue
                    d = np.sqrt(((points[at] - asked[q]) ** 2).sum(1))
                    near = d <= worst[q]
                    have = held.get(q, (np.zeros(0, np.int64), np.zeros(0)))
                    n, d = np.concatenate([have[0], names[at[near]]]), np.concatenate([have[1], d[near]])
                    best = np.lexsort((n, np.round(d, exact.DIGITS)))[:k]
                    held[q] = (n[best], d[best])
                    if len(best) == k:
                        worst[q] = min(worst[q], d[best[-1]] + 10.0**-exact.DIGITS)
        for q, (n, d) in held.items():
            if len(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), ids[q])), pa.array(n), pa.array(d)], ["query_id", "vec_id", "distance"])

    return rows.select("vec_id", "v", "c", "r").mapInArrow(run, "query_id long, vec_id long, distance double")


def _top(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("distance", F.round("distance", exact.DIGITS))
    by = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return ranked.withColumn("rank", F.row_number().over(by).cast("long")).where(F.col("rank") <= k)


def _stored(found: DataFrame) -> DataFrame:
    """The best of the nearest cells, k a query, in the shared folder: they are read twice."""
    to = fresh_folder(found.sparkSession, "pivots")
    found.write.parquet(to)
    return found.sparkSession.read.parquet(to)


def knn(index: Index, queries: DataFrame, k: int, *, query_id: str = "query_id", vector: str = "embedding", block_bytes: int = exact.BLOCK_BYTES, told: dict | None = None) -> DataFrame:
    """query_id, vec_id, distance, rank: as ``vector.knn`` over the indexed vectors. Queries come in blocks of bounded size. told, if given, is
    told how many rows were read (``rows``) by conditions, which counts them first."""
    spark, dim = queries.sparkSession, index.pivots.shape[1]
    asked = queries.where(F.size(vector) == dim).select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).alias("v"))
    n_blocks = int(8 * dim * asked.count() // block_bytes) + 1
    out = None
    for b in range(n_blocks):
        got = (asked if n_blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == b)).collect()
        ids, points = np.array([r["query_id"] for r in got], np.int64), np.array([r["v"] for r in got], float).reshape(-1, dim)
        far = np.sqrt(np.maximum(((points[:, None, :] - index.pivots[None]) ** 2).sum(2), 0)) if len(got) else np.zeros((0, len(index.pivots)))
        usable = np.where(np.isfinite(index.least), far, np.inf)
        if not len(got) or not np.isfinite(usable).any():
            continue
        home = usable.argmin(1)
        plan: dict[int, list] = {}
        for q, c in enumerate(home.tolist()):
            plan.setdefault(c, []).append((q, index.least[c], index.most[c]))
        first = _search(index, spark, ids, points, plan, np.full(len(ids), np.inf), k, told)
        first = _stored(_top(first, k))
        bound = np.full(len(ids), np.inf)
        place = {i: [] for i in ids.tolist()}
        for q, i in enumerate(ids.tolist()):
            place[i].append(q)
        for r in first.where(F.col("rank") == k).select("query_id", "distance").collect():  # a number a query of the block
            for q in place[r["query_id"]]:
                bound[q] = r["distance"] + 2 * 10.0**-exact.DIGITS
        plan = {}
        for q in range(len(ids)):
            low, high = np.maximum(far[q] - bound[q], index.least), np.minimum(far[q] + bound[q], index.most)
            for c in np.flatnonzero(low <= high).tolist():
                if c != home[q]:
                    plan.setdefault(c, []).append((q, low[c] - 1e-9, high[c] + 1e-9))
        both = first.select("query_id", "vec_id", "distance")
        if plan:
            both = both.unionByName(_search(index, spark, ids, points, plan, bound, k, told))
        part = _top(both, k)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, vec_id long, distance double, rank long")
