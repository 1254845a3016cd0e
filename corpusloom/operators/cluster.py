"""Clustering: k-means, centroids, labels, confidence, units, and projection by principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import trust
from ..session import fresh_folder


#: Tasks that sum the matrices of all tasks.
SUMMED = 8


def default_k(n: int) -> int:
    return max(1, min(n, int((n / 2) ** 0.5)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each point; of equal distances to 9 digits the first."""
    d = (points**2).sum(1)[:, None] + (centroids**2).sum(1)[None] - 2 * points @ centroids.T
    return np.round(d, 9).argmin(axis=1)


def assign(vectors: DataFrame, centroids: np.ndarray, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster of every vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_gaps(_matrix(batch.column(1)), sent.value)[0])], ["vec_id", "cluster"])

    return vectors.where(F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), vector).mapInArrow(run, "vec_id long, cluster long")


def _gaps(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance to it) of each point; 0 exactly for equal ones."""
    c = np.zeros(len(points), np.int64)
    step = max(1, (1 << 22) // len(centroids))
    for low in range(0, len(points), step):
        c[low : low + step] = nearest(points[low : low + step], centroids)
    return c, ((points - centroids[c]) ** 2).sum(1)


def _seeds(vectors: DataFrame, k: int, vec_id: str, vector: str, seed: int, rounds: int = 5) -> np.ndarray:
    """k-means|| over all vectors: each round draws max(2 k, 64) of them, weighted by the squared distance to those drawn before; of
    the drawn, weighted by the number of vectors nearest to them, k-means++ takes k. A draw is that of least -log(u) / weight, u
    being a hash of the id and the vector. Vectors of which fewer than k differ give repeated seeds."""
    many, spark = max(2 * k, 64), vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"))
    drawn, step = None, 0
    while drawn is None or step <= rounds or len(drawn) < k:
        n = many if step else 1
        sent = spark.sparkContext.broadcast(drawn)

        def draw(batches: Iterator[pa.RecordBatch], sent=sent, n=n) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    gap = np.ones(batch.num_rows) if sent.value is None else _gaps(_matrix(batch.column(1)), sent.value)[1]
                    u = ((batch.column(2).to_numpy().view(np.uint64) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
                    key = np.divide(-np.log(u), gap, out=np.full(len(gap), np.inf), where=gap > 0)
                    best = np.argsort(key, kind="stable")[:n]
                    best = pa.array(best[np.isfinite(key[best])])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(best), batch.column(1).take(best), pa.array(key).take(best)], ["vec_id", "v", "key"])

        hashed = rows.withColumn("h", F.xxhash64("vec_id", "v", F.lit(seed), F.lit(step)))
        best = hashed.mapInArrow(draw, rows.withColumn("key", F.lit(0.0)).schema).orderBy("key", "vec_id").limit(n).select("v").collect()
        if not best:
            break
        new = np.array([r[0] for r in best], float)
        drawn = np.unique(new if drawn is None else np.concatenate([drawn, new]), axis=0)
        step += 1
    sent = spark.sparkContext.broadcast(drawn)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_gaps(_matrix(batch.column(0)), sent.value)[0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["c", "n"])

    weight = np.zeros(len(drawn))
    for r in rows.select("v").mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():
        weight[r["c"]] = r["n"]
    rng = np.random.default_rng(seed)
    pick = lambda w: drawn[min(np.searchsorted(np.cumsum(w), rng.random() * w.sum(), "right"), len(w) - 1)]
    out = [pick(weight)]
    d = ((drawn - out[0]) ** 2).sum(1)
    while len(out) < k:
        out.append(pick(d * weight) if (d * weight).sum() > 0 else drawn[len(out) % len(drawn)])
        d = np.minimum(d, ((drawn - out[-1]) ** 2).sum(1))
    return np.array(out)


def two_nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, distance to it, distance to the nearest other one, infinite if there is none), in tiles of bounded size."""
    c, own, other = np.zeros(len(points), np.int64), np.zeros(len(points)), np.full(len(points), np.inf)
    step = max(1, (1 << 22) // len(centroids))
    norms = (centroids**2).sum(1)[None]
    for low in range(0, len(points), step):
        x = points[low : low + step]
        d = np.round((x**2).sum(1)[:, None] + norms - 2 * x @ centroids.T, 9)
        at = np.arange(len(x))
        c[low : low + step] = k = d.argmin(axis=1)
        own[low : low + step] = np.sqrt(np.maximum(d[at, k], 0))
        if len(centroids) > 1:
            d[at, k] = np.inf
            other[low : low + step] = np.sqrt(np.maximum(d.min(axis=1), 0))
    return c, own, other


#: What bounds must be apart to decide, so that distances that are equal to 9 digits are compared themselves.
_APART = 1e-4


def bounded(points: np.ndarray, c: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, ...]:
    """(cluster, upper, lower, which vectors had all their distances computed) after the centroids have moved by ``drift``.

    upper bounds the distance to a vector's own centroid from above, lower that to all others from below; both move with the centroids. A
    vector whose bounds do not meet keeps its cluster, as does one that is nearer to its centroid than half way to any other (Hamerly's bounds)."""
    c, upper, order = c.copy(), upper + drift[c], np.argsort(drift)
    most, second = drift[order[-1]], drift[order[-2]] if len(drift) > 1 else 0.0
    lower = lower - np.where(c == order[-1], second, most)
    half = two_nearest(centroids, centroids)[2] / 2
    # A centroid's nearest other one: of equal centroids each has the other at distance 0.
    bound = np.maximum(lower, half[c])
    open_ = np.flatnonzero(upper + _APART >= bound)
    upper[open_] = np.sqrt(((points[open_] - centroids[c[open_]]) ** 2).sum(1))
    open_ = open_[upper[open_] + _APART >= bound[open_]]
    c[open_], upper[open_], lower[open_] = two_nearest(points[open_], centroids)
    return c, upper, lower, open_


_STATE = "vec_id long, v array<{}>, c long, upper double, lower double, moved boolean, computed boolean"


def _state(batch: pa.RecordBatch, c, upper, lower, moved, computed) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c), pa.array(upper), pa.array(lower), pa.array(moved), pa.array(computed)], [x.split()[0] for x in _STATE.split(", ")])


def lloyd(vectors: DataFrame, seeds: np.ndarray, *, rounds: int, share: float | None = None, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray, list[tuple[int, int]]]:
    """(vec_id and cluster, the centroids that these are nearest to, (moved, computed) of each round) after at most ``rounds`` rounds from given
    seeds; with ``share``, after one in which fewer than that share of the vectors moved.

    A round assigns each vector once, and writes it with its cluster and bounds to a table in the shared folder, from which the next
    round goes on; only vectors whose bounds meet are compared with all centroids. Tasks sum their vectors by cluster, and the driver gets
    a sum for each cluster. An empty cluster keeps its centroid. Null vectors are left out."""
    spark, centroids = vectors.sparkSession, np.asarray(seeds, float)
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    kind = rows.schema["v"].dataType.elementType.simpleString()
    if kind not in ("float", "double"):
        kind, rows = "double", rows.withColumn("v", F.col("v").cast("array<double>"))
    state, table, drift, told, path = _STATE.format(kind), rows, None, [], fresh_folder(spark, "kmeans")
    for step in range(rounds):
        sent = spark.sparkContext.broadcast((centroids, drift))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            now, drift = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                points = _matrix(batch.column(1))
                if drift is None:
                    yes = np.ones(len(points), bool)
                    yield _state(batch, *two_nearest(points, now), yes, yes)
                    continue
                old = batch.column(2).to_numpy()
                c, upper, lower, computed = bounded(points, old, batch.column(3).to_numpy(), batch.column(4).to_numpy(), now, drift)
                yield _state(batch, c, upper, lower, c != old, np.isin(np.arange(len(c)), computed))

        columns = ["vec_id", "v"] if drift is None else ["vec_id", "v", "c", "upper", "lower"]
        table.select(*columns).mapInArrow(run, state).write.parquet(f"{path}/{step}")
        table = spark.read.schema(state).parquet(f"{path}/{step}")
        total, count, moved, computed = _sums(table, centroids)
        told.append((moved, computed))
        used, centroids = centroids, np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
        if moved == 0 or share is not None and step and moved < share * count.sum():
            break
        drift = np.sqrt(((centroids - used) ** 2).sum(1))
    return table.select("vec_id", F.col("c").alias("cluster")), used, told


def _sums(table: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(sum of vectors and number of vectors of each cluster, vectors that moved, vectors that were compared with all centroids)."""
    k, dim = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, moved, computed = np.zeros((k, dim)), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                points, c = _matrix(batch.column(0)), batch.column(1).to_numpy()
                order = np.argsort(c, kind="stable")
                first = np.flatnonzero(np.diff(c[order], prepend=-1))
                total[c[order][first]] += np.add.reduceat(points[order], first)
                for out, some in ((count, slice(None)), (moved, batch.column(2).to_numpy(zero_copy_only=False)), (computed, batch.column(3).to_numpy(zero_copy_only=False))):
                    out += np.bincount(c[some], minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(total[some]), pa.list_(pa.float64())), pa.array(count[some]), pa.array(moved[some]), pa.array(computed[some])], ["c", "total", "n", "moved", "computed"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]  # of each task a row for each cluster at most
        if got:
            rows = pa.Table.from_batches(got).combine_chunks().to_batches()[0]
            c, at = np.unique(rows.column(0).to_numpy(), return_inverse=True)
            total, n = np.zeros((len(c), dim)), np.zeros((3, len(c)), np.int64)
            np.add.at(total, at, _matrix(rows.column(1)))
            for i in range(3):
                np.add.at(n[i], at, rows.column(2 + i).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(list(total), pa.list_(pa.float64())), *map(pa.array, n)], ["c", "total", "n", "moved", "computed"])

    schema = "c long, total array<double>, n long, moved long, computed long"
    by = table.select("v", "c", "moved", "computed").mapInArrow(sums, schema).repartition(SUMMED, "c").mapInArrow(add, schema)
    total, count, got = np.zeros((k, dim)), np.zeros(k, np.int64), by.collect()
    for r in got:
        total[r["c"]], count[r["c"]] = r["total"], r["n"]
    return total, count, sum(r["moved"] for r in got), sum(r["computed"] for r in got)


def kmeans(vectors: DataFrame, k: int, *, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 42, rounds: int = 100) -> tuple[DataFrame, np.ndarray]:
    """(vec_id and cluster, centroids): ``lloyd`` from seeds drawn over all vectors, until less than 0.1 % of the vectors move."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    n = rows.count()
    if n == 0:
        return assign(vectors, np.zeros((1, 1)), vec_id=vec_id, vector=vector), np.zeros((0, 0))
    found, centroids, _ = lloyd(rows, _seeds(rows, min(k, n), "vec_id", "v", seed), rounds=rounds, share=0.001, vec_id="vec_id", vector="v")
    return found, centroids


def centroids_of(members: DataFrame, cluster: str, vector: str, digits: int = 6) -> DataFrame:
    """cluster, pos, value: the mean vector of each cluster."""
    flat = members.select(cluster, F.posexplode(vector).alias("pos", "x"))
    return flat.groupBy(cluster, "pos").agg(F.round(F.avg(F.col("x").cast("double")), digits).alias("value"))


def mode(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """key, name, n_name, of: the commonest value (ties: the least), how often it stands, how many rows the key has."""
    counts = rows.select(key, value.alias(name)).groupBy(key, name).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max_by(name, F.struct("n", _reverse(name))).alias(name), F.max("n").alias(f"n_{name}"), F.sum("n").alias("of"), F.count(name).alias(f"kinds_{name}"))


def _reverse(name: str) -> Column:
    """A key that orders texts the other way round: each character mirrored, an end mark above all."""
    mirrored = F.transform(F.split(F.col(name), ""), lambda c: F.lit(0x110000) - F.ascii(c))
    return F.concat(mirrored, F.array(F.lit(0x110000)))


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def compact(path: Column, n: int = 2) -> Column:
    parts = F.split(F.trim(path, F.lit("/")), "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), "/")


def topics(members: DataFrame, cluster: str = "cluster") -> DataFrame:
    """cluster, topic: the commonest directory (last two parts), with the commonest extension where the directory is of one
    part and holds under 70 %, after the source's name where one source has 70 %. members: source_name, source_path."""
    path = F.col("source_path")
    dirs = mode(members, cluster, directory(path), "dir")
    exts = mode(members.where(extension(path) != ""), cluster, extension(path), "ext").select(cluster, "ext")
    sources = mode(members, cluster, F.col("source_name"), "src").select(cluster, "src", "n_src", "kinds_src")
    out = dirs.join(sources, cluster).join(exts, cluster, "left")
    most = F.floor(F.col("of") * 7 / 10)
    root = F.col("dir").isin("", ".", "/")
    ext = F.coalesce(F.concat(F.lit(" "), "ext"), F.lit(""))
    short = compact(F.col("dir"))
    topic = F.when(root, F.concat(F.lit("root"), ext)).when((F.instr(short, "/") == 0) & (F.col("n_dir") < most), F.concat(short, ext)).otherwise(short)
    one = (F.col("kinds_src") == 1) | (F.col("n_src") >= most)
    return out.select(cluster, F.when(one & (F.col("src") != ""), F.concat("src", F.lit(": "), topic)).otherwise(topic).alias("topic"))


def confidence(members: DataFrame, cluster: str = "cluster", as_of: str = trust.AS_OF) -> DataFrame:
    """cluster, freshness, corroboration, consistency, authority, overall. members: content_date, file_type, confidence_adj, source_name."""
    none = F.lit(None).cast("timestamp")
    out = members.groupBy(cluster).agg(
        trust.round2(F.round(F.avg(trust.freshness(F.col("content_date"), none, F.col("file_type"), as_of)), 9)).alias("freshness"),
        trust.corroboration(F.countDistinct("source_name")).alias("corroboration"),
        trust.round2(F.round(F.avg(trust.consistency(F.col("confidence_adj"))), 9)).alias("consistency"),
        trust.round2(F.round(F.avg(trust.authority(F.col("file_type"))), 9)).alias("authority"),
    )
    return out.withColumn("overall", trust.overall(*map(F.col, ("freshness", "corroboration", "consistency", "authority"))))


def summaries(members: DataFrame, cluster: str = "cluster", most: int = 5) -> DataFrame:
    """cluster, summary: the first five paths, with their number where there are more. The paths are numbered by an ordered
    window over distinct paths, of which only the first are gathered."""
    paths = members.select(cluster, "source_path").distinct()
    first = Window.partitionBy(cluster).orderBy("source_path")
    few = paths.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most)
    few = few.groupBy(cluster).agg(F.array_join(F.sort_array(F.collect_list("source_path")), ", ").alias("list"))
    n = paths.groupBy(cluster).agg(F.count("*").alias("n"))
    text = F.when(F.col("n") > most, F.concat(F.lit("Covers "), F.col("n").cast("string"), F.lit(" files including "), "list")).otherwise(F.concat(F.lit("Covers "), "list"))
    return few.join(n, cluster).select(cluster, text.alias("summary"))


def unit_ids(members: DataFrame, cluster: str = "cluster") -> DataFrame:
    """cluster, unit_id, n: first 16 hex digits of sha256("unit:cluster:sorted ids")."""
    ids = members.groupBy(cluster).agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"), F.count("*").alias("n"))
    return ids.select(cluster, F.substring(F.sha2(F.concat(F.lit("unit:"), F.col(cluster).cast("string"), F.lit(":"), "ids"), 256), 1, 16).alias("unit_id"), "n")


def pca(vectors: DataFrame, dims: int = 2, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, x0 .. : projections on the first principal components of the centred vectors. Tasks sum vectors and their
    products; the driver decomposes one matrix of dimension squared. A component's sign makes its largest entry positive."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, None, None
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(1))
                n += len(m)
                total = m.sum(0) if total is None else total + m.sum(0)
                products = m.T @ m if products is None else products + m.T @ m
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "total": [total.tobytes()], "products": [products.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, 0.0, 0.0
        for batch in batches:
            for k, t, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n, total, products = n + k, total + np.frombuffer(t), products + np.frombuffer(p)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "total": [total.tobytes()], "products": [products.tobytes()]})

    # The tasks' matrices are summed in a few tasks first, so that the driver adds SUMMED of them, however many tasks there are.
    schema = "n long, total binary, products binary"
    parts = rows.mapInArrow(sums, schema).repartition(SUMMED).mapInArrow(add, schema).collect()
    n, total, products = 0, 0.0, 0.0
    for r in sorted(parts, key=lambda r: (r["n"], r["total"])):
        n, total, products = n + r["n"], total + np.frombuffer(r["total"]), products + np.frombuffer(r["products"])
    out = ", ".join(f"x{i} double" for i in range(dims))
    if not n:
        return rows.select("vec_id", *(F.lit(0.0).alias(f"x{i}") for i in range(dims)))
    mean = total / n
    d = len(mean)
    values, axes = np.linalg.eigh(products.reshape(d, d) / n - np.outer(mean, mean))
    axes = axes[:, np.argsort(-values)][:, :dims]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    axes = np.pad(axes, ((0, 0), (0, dims - axes.shape[1])))
    sent = vectors.sparkSession.sparkContext.broadcast((mean, axes))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, axes = sent.value
        for batch in batches:
            if batch.num_rows:
                p = (_matrix(batch.column(1)) - mean) @ axes
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, i].copy()) for i in range(dims))], ["vec_id", *(f"x{i}" for i in range(dims))])

    return rows.mapInArrow(project, f"vec_id long, {out}")
