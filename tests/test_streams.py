"""Keyed state and the tree source: batches in any order, restarts, and brute force."""

import datetime
import glob
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import models, trust
from corpusloom.plans import corpus
from corpusloom.plans.store import Store
from corpusloom.sources import tree
from corpusloom.streaming import ingest, state

START = datetime.datetime(2024, 1, 1)
EVENTS = "event_id long, user string, ts timestamp"


def seen(rows, until):
    """(key, id, seen) of rows up to a time, from distinct rows in order."""
    out, last = set(), {}
    for at, i, k in sorted({(at, i, k) for i, k, at in rows if None not in (i, k, at)}):
        if at <= until:
            out.add((k, i, k in last and at - last[k] <= datetime.timedelta(minutes=10)))
        last[k] = at
    return out


def run(spark, at, batches):
    """One file a run, each run from the checkpoint of the one before."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(EVENTS).parquet(f"{at}/in")
        state.run_to_files(state.seen_within(stream, "user", "event_id", "ts", late="1 hour"), f"{at}/out", f"{at}/cp")
    out = [tuple(r) for r in spark.read.parquet(f"{at}/out").collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_answers_do_not_depend_on_arrival(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("abcd"), START + datetime.timedelta(seconds=40 * i + rnd.randrange(600))) for i in range(300)]
    rows += rnd.sample(rows, 30) + [(None, "a", START), (1, None, START), (2, "a", None)]
    # batches in order of time, each with rows up to 50 minutes late, and shuffled
    near = sorted(rows, key=lambda r: ((r[2] or START) + datetime.timedelta(minutes=rnd.randrange(50)), r[0] or 0))
    batches = [near[k : k + 70] for k in range(0, len(near), 70)]
    for b in batches:
        rnd.shuffle(b)
    newest = max(r[2] for r in rows if r[2])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    got = run(spark, str(tmp_path), batches)
    assert got == seen(rows, newest - datetime.timedelta(hours=1)) and any(s for _, _, s in got) and not all(s for _, _, s in got)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    m = lambda k: START + datetime.timedelta(minutes=k)
    got = run(spark, str(tmp_path), [[(1, "a", m(0)), (2, "a", m(5)), (3, "b", m(300))], [(4, "a", m(7)), (5, "a", m(290)), (6, "a", m(299))], [(7, "z", m(900))]])
    assert got == {("a", 1, False), ("a", 2, True), ("b", 3, False), ("a", 5, False), ("a", 6, True)}


# The tree


def put(root, path, text):
    os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
    with open(f"{root}/{path}", "w") as f:
        f.write(text)
    put.clock += 1
    os.utime(f"{root}/{path}", (put.clock, put.clock))


put.clock = 1_700_000_000


def events(spark, at, **options):
    spark.dataSource.register(tree.Tree)
    stream = spark.readStream.format("corpus_tree").option("path", f"{at}/tree").option("journal", f"{at}/journal")
    for k, v in options.items():
        stream = stream.option(k, v)
    out = stream.load().writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start()
    out.awaitTermination()


def told(spark, at):
    return sorted((r["seq"], r["state"] == "deleted", r["source_path"], None if r["raw_content"] is None else bytes(r["raw_content"]).decode()) for r in spark.read.parquet(f"{at}/out").collect())


def test_tree_of_files(spark, tmp_path):
    at = str(tmp_path)
    for k in range(7):
        put(f"{at}/tree", f"d{k % 2}/f{k}.md", f"text {k}")
    put(f"{at}/tree", ".hidden/x.md", "no")
    put(f"{at}/tree", "big.md", "x" * 100)
    events(spark, at, files_per_task=2, most_bytes=50, most_segments=2)
    first = [(1, False, "big.md", None)] + sorted((1, False, f"d{k % 2}/f{k}.md", f"text {k}") for k in range(7))
    assert told(spark, at) == first
    assert spark.read.parquet(f"{at}/out").where("source_path = 'd0/f0.md'").first()["checksum"] == hashlib.sha256(b"text 0").hexdigest()
    events(spark, at, most_bytes=50, most_segments=2)  # nothing has changed
    assert told(spark, at) == first
    want = list(first)
    for n in range(2, 7):  # changes, deletions and returns, over states of the journal that are written on the way
        put(f"{at}/tree", f"d0/f{n}.md", f"again {n}")
        want.append((n, False, f"d0/f{n}.md", f"again {n}"))
        if n == 3:
            os.remove(f"{at}/tree/d1/f1.md")
            want.append((n, True, "d1/f1.md", None))
        if n == 5:
            put(f"{at}/tree", "d1/f1.md", "back")
            want.append((n, False, "d1/f1.md", "back"))
        events(spark, at, most_bytes=50, most_segments=2)
        assert told(spark, at) == sorted(want)
    assert glob.glob(f"{at}/journal/state-*") and len(glob.glob(f"{at}/journal/*")) < 6


def test_a_stop_between_listing_and_reading(spark, tmp_path):
    """The segment is there, Spark has not heard of it: the next run reads it once. A file that went meanwhile has no row."""
    at = str(tmp_path)
    put(f"{at}/tree", "a.md", "1")
    put(f"{at}/tree", "b.md", "2")
    reader = tree.TreeStreamReader({"path": f"{at}/tree", "journal": f"{at}/journal"})
    assert reader.latestOffset() == {"segment": 1} == reader.latestOffset()
    os.remove(f"{at}/tree/b.md")
    events(spark, at)
    assert told(spark, at) == [(1, False, "a.md", "1"), (2, True, "b.md", None)]
    with pytest.raises(ValueError):
        tree.Tree({"path": "x"}).streamReader(None)
    assert tree.listing(f"{at}/none") == {}


def test_a_stored_tree_follows(spark, tmp_path):
    at, store = str(tmp_path), Store(spark, f"file://{tmp_path}/store")
    go = lambda: ingest.ingest_tree(spark, f"{at}/tree", store, models.HashEmbedder(4), f"{at}/cp", trust.AS_OF, name="docs").awaitTermination()
    stored = lambda: {r["source_path"]: r["raw_content"] for r in store.read(corpus.FRAGMENTS).collect()}
    put(f"{at}/tree", "a.md", "alpha")
    put(f"{at}/tree", "node_modules/x.md", "never")
    put(f"{at}/tree", "sub/b.txt", "beta")
    go()
    assert stored() == {"a.md": "alpha", "sub/b.txt": "beta"}
    os.remove(f"{at}/tree/a.md")
    put(f"{at}/tree", "sub/b.txt", "beta\0binary now")
    put(f"{at}/tree", "c.md", "gamma")
    go()
    assert stored() == {"c.md": "gamma"}
    assert store.read(corpus.FRAGMENTS).where(F.col("content_date").isNull()).count() == 0
