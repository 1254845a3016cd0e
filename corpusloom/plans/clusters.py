"""Clustering of a corpus into knowledge units, and their picture."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import trust
from ..functions.text import first_bytes
from ..operators import cluster
from .store import Store

UNITS = "units"


def run(fragments: DataFrame, k: int | None = None, *, seed: int = 42, as_of: str = trust.AS_OF) -> tuple[DataFrame, DataFrame]:
    """(doc_id and cluster, units) of fragments with an embedding. units: cluster, unit_id, n, topic, summary, trust, centroid, and
    fragment_ids, the ids of its members in order."""
    rows = fragments.where(F.col("embedding").isNotNull())
    k = cluster.default_k(rows.count()) if k is None else k
    found, centroids = cluster.kmeans(rows, k, vec_id="doc_id", seed=seed)
    found = found.withColumnRenamed("vec_id", "doc_id")
    members = rows.join(found, "doc_id")
    middle = fragments.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cluster long, centroid array<double>")
    ids = members.groupBy("cluster").agg(F.sort_array(F.collect_list("id")).alias("fragment_ids"))
    units = cluster.unit_ids(members).join(ids, "cluster").join(cluster.topics(members), "cluster").join(cluster.summaries(members), "cluster")
    return found, units.join(cluster.confidence(members, as_of=as_of), "cluster").join(middle, "cluster")


def store(units: DataFrame, to: Store, computed_at: str) -> None:
    """Replace the stored units (with the time they were computed at) by these."""
    to.write(UNITS, units.withColumn("last_computed", F.lit(computed_at).cast("timestamp")))


def members_of(to: Store, unit_ids: list[str]) -> DataFrame:
    """unit_id, pos, fragment_id of stored units, in order."""
    rows = to.read(UNITS).where(F.col("unit_id").isin(*unit_ids)).select("unit_id", F.posexplode("fragment_ids").alias("pos", "fragment_id"))
    return rows.orderBy("unit_id", "pos")


def points(fragments: DataFrame, found: DataFrame, units: DataFrame, dims: int = 2) -> DataFrame:
    """doc_id, x0 .. , cluster, label (the unit's topic), preview (120 bytes of text) of every clustered fragment, in 2 or 3 dimensions."""
    rows = fragments.where(F.col("embedding").isNotNull())
    at = cluster.pca(rows, dims, vec_id="doc_id").withColumnRenamed("vec_id", "doc_id")
    text = rows.select("doc_id", first_bytes(F.col("raw_content"), 120).alias("preview"))
    return at.join(found, "doc_id").join(units.select("cluster", F.col("topic").alias("label")), "cluster").join(text, "doc_id")


def picture(points: DataFrame, most: int | None = None) -> str:
    """An HTML page of points (doc_id, x0, x1, cluster, label; x2 is shown by size): all of them, as many as a browser is to hold, or the
    ``most`` of least doc_id."""
    depth = F.col("x2") if "x2" in points.columns else F.lit(0.0)
    rows = points.orderBy("doc_id").select("doc_id", "x0", "x1", "cluster", "label", depth.alias("x2"))
    rows = rows if most is None else rows.limit(most)
    data = json.dumps([[r["x0"], r["x1"], r["cluster"], r["label"], r["x2"]] for r in rows.toLocalIterator()]).replace("</", "<\\/")
    return (
        "<!DOCTYPE html><meta charset='utf-8'><title>Clusters</title><canvas id='c' width='900' height='900'></canvas><script>"
        f"const p={data},g=document.getElementById('c').getContext('2d');"
        "const r=i=>{const v=p.map(q=>q[i]),a=v.reduce((x,y)=>Math.min(x,y),1/0),b=v.reduce((x,y)=>Math.max(x,y),-1/0);return x=>(x-a)/((b-a)||1)},X=r(0),Y=r(1),Z=r(4);"
        "p.forEach(q=>{const s=3+3*Z(q[4]);g.fillStyle=`hsl(${q[2]*137%360} 60% 45%)`;g.fillRect(20+860*X(q[0])-s/2,20+860*Y(q[1])-s/2,s,s)})</script>"
    )
