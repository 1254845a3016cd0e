"""Bounds of k-means against plain rounds."""

import numpy as np
import pytest

from corpusloom.operators import cluster


def plain(points, centroids, rounds):
    for _ in range(rounds):
        used, c = centroids, cluster.nearest(points, centroids)
        centroids = np.array([points[c == k].mean(0) if (c == k).any() else centroids[k] for k in range(len(centroids))])
    return c, used


@pytest.mark.parametrize("k", (1, 2, 7, 40))
def test_bounds_decide_as_distances_do(k):
    rng = np.random.default_rng(k)
    points = np.concatenate([rng.normal(0, 1, (400, 5)), rng.integers(0, 2, (200, 5)).astype(float)])
    centroids = np.concatenate([points[:k], points[:1]]) if k == 7 else points[:k]
    c, upper, lower = cluster.two_nearest(points, centroids)
    computed = 0
    for _ in range(15):
        used = centroids
        centroids = np.array([points[c == j].mean(0) if (c == j).any() else used[j] for j in range(len(used))])
        c, upper, lower, open_ = cluster.bounded(points, c, upper, lower, centroids, np.sqrt(((centroids - used) ** 2).sum(1)))
        computed += len(open_)
        d = np.sqrt(((points[:, None] - centroids[None]) ** 2).sum(2))
        assert (c == cluster.nearest(points, centroids)).all()
        assert (upper >= d[np.arange(len(c)), c] - 1e-6).all()
        d[np.arange(len(c)), c] = np.inf
        assert (lower <= d.min(1) + 1e-6).all()
    assert computed < 15 * len(points) or k == 7


def test_rounds_from_seeds(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(m, 1.0, (150, 3)) for m in (-4, 0, 4, 9)])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(9999, None)], "vec_id long, embedding array<double>").repartition(5)
    seeds = np.concatenate([points[[0, 1, 2, 200, 400]], [[1e6, 1e6, 1e6]]])  # the last stays empty
    found, used, told = cluster.lloyd(df, seeds, rounds=6)
    c, centroids = plain(points, seeds, 6)
    assert {r["vec_id"]: r["cluster"] for r in found.collect()} == dict(enumerate(c.tolist())) and np.allclose(used, centroids)
    assert told[0] == (600, 600) and told[-1][1] < 300
    stopped = cluster.lloyd(df, seeds, rounds=50, share=0.5)[2]
    assert len(stopped) == 2 or stopped[-1][0] < 300


def test_rounds_keep_the_type_of_vectors(spark, tmp_path, monkeypatch):
    """Vectors are written as they are, and summed by tasks as brute force does."""
    monkeypatch.setattr(cluster, "fresh_folder", lambda spark, name: f"{tmp_path}/{name}")
    points = np.random.default_rng(3).normal(0, 1, (300, 4)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>").repartition(4)
    found, used, told = cluster.lloyd(df, points[:6], rounds=4)
    c, centroids = plain(points, points[:6], 4)
    assert {r["vec_id"]: r["cluster"] for r in found.collect()} == dict(enumerate(c.tolist())) and np.allclose(used, centroids)
    table = spark.read.parquet(f"{tmp_path}/kmeans/3")
    assert dict(table.dtypes)["v"] == "array<float>"
    total, count, moved, computed = cluster._sums(table, used)
    assert np.allclose(total, [points[c == k].sum(0) for k in range(6)]) and count.tolist() == np.bincount(c, minlength=6).tolist() and (moved, computed) == told[-1]
