"""The store: changes against brute force, writers at once, sizes, compaction, and what a corpus keeps of its documents."""

import datetime
import glob
import os
import random
import subprocess
import threading

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import models, trust
from corpusloom.plans import corpus
from corpusloom.plans import query as plans
from corpusloom.plans.store import Conflict, Store
from corpusloom.sources import registry
from corpusloom.streaming import ingest as streams

SCHEMA = "a string, b long, v long"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_changes_against_brute_force(spark, tmp_path):
    rnd, store, state = random.Random(1), Store(spark, f"file://{tmp_path}"), {}
    keys = [(a, b) for a in ("x", "y", None) for b in (1, 2, 3, None)]
    for step in range(9):
        rows = [(*rnd.choice(keys), rnd.randrange(100)) for _ in range(rnd.randrange(6))]
        gone = [rnd.choice(keys) for _ in range(rnd.randrange(4))]
        store.change("t", spark.createDataFrame(rows, SCHEMA), ["a", "b"], spark.createDataFrame(gone, "a string, b long"))
        state = {k: v for k, v in state.items() if k not in set(gone) | {r[:2] for r in rows}}
        for a, b, v in rows:
            state.setdefault((a, b), []).append(v)
        if step == 5:
            store.compact("t")
            assert len(store.state("t").folders) == 1
        want = sorted(((a, b, v) for (a, b), vs in state.items() for v in vs), key=repr)
        assert rows_of(store.read("t"), "a", "b", "v") == want
    with pytest.raises(ValueError):
        store.change("t", spark.createDataFrame([], SCHEMA), ["a"])


def test_new_columns_and_old_states(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    first = store.write("t", spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), key=["k"])
    then = store.change("t", spark.createDataFrame([(2, "c", 0.5)], "k long, v string, w double"), ["k"])
    assert rows_of(store.read("t"), "k", "v", "w") == [(1, "a", None), (2, "c", 0.5)]
    assert rows_of(store.read("t", first), "k", "v") == [(1, "a"), (2, "b")]
    store.compact("t")
    assert store.forget("t", keep=1) == 2 and rows_of(store.read("t"), "k", "v", "w") == [(1, "a", None), (2, "c", 0.5)]
    with pytest.raises(KeyError):
        store.read("t", then)
    assert store.forget("t", keep=1) == 0


def test_writers_at_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.write("t", spark.createDataFrame([(0, 0)], "k long, v long"), key=["k"])
    errors = []

    def work(n):
        try:
            Store(spark, f"file://{tmp_path}").change("t", spark.createDataFrame([(n, n)], "k long, v long"), ["k"])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(1, 7)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and rows_of(store.read("t"), "k", "v") == [(n, n) for n in range(7)]


def test_a_rewrite_from_an_old_state_begins_again(spark, tmp_path):
    """Two writers read one state; the second to finish sees the first one's rows."""
    store, other, seen = Store(spark, f"file://{tmp_path}"), Store(spark, f"file://{tmp_path}"), []
    store.write("t", spark.createDataFrame([(0,)], "k long"))

    def late(t):
        if not seen:
            other.update("t", lambda o: o.unionByName(spark.createDataFrame([(10,)], "k long")))
        seen.append(1)
        return t.unionByName(spark.createDataFrame([(20,)], "k long"))

    store.update("t", late)
    assert rows_of(store.read("t"), "k") == [(0,), (10,), (20,)] and len(seen) == 2

    def always(t):
        other.update("t", lambda o: o)
        return t

    store.TRIES = 2
    with pytest.raises(Conflict):
        store.update("t", always)


def test_compaction_keeps_what_comes_meanwhile(spark, tmp_path, monkeypatch):
    store, other = Store(spark, f"file://{tmp_path}"), Store(spark, f"file://{tmp_path}")
    for k in range(3):
        store.change("t", spark.createDataFrame([(k, 1)], "k long, v long"), ["k"])
    before = store._put

    def slow(name, df, by):
        folder = before(name, df, by)
        other.change("t", spark.createDataFrame([(1, 2)], "k long, v long"), ["k"])
        return folder

    monkeypatch.setattr(store, "_put", slow)
    store.compact("t")
    assert rows_of(store.read("t"), "k", "v") == [(0, 1), (1, 2), (2, 1)] and len(store.state("t").folders) == 2
    monkeypatch.setattr("corpusloom.plans.store.MOST_CHANGES", 2)
    for k in range(3):
        other.change("t", spark.createDataFrame([(k, 5)], "k long, v long"), ["k"])
    assert len(other.state("t").folders) <= 3 and rows_of(other.read("t"), "v") == [(5,)] * 3


def test_half_a_state_is_none(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.write("t", spark.createDataFrame([(1,)], "k long"), key=["k"])
    with open(f"{tmp_path}/t/_current/{1:010d}", "w") as f:
        f.write('{"number": 1, "fold')
    assert rows_of(store.read("t"), "k") == [(1,)]
    store.change("t", spark.createDataFrame([(2,)], "k long"), ["k"])
    assert rows_of(store.read("t"), "k") == [(1,), (2,)]


def test_a_small_change_is_a_small_write(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    size = lambda: sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/t/**/*.parquet", recursive=True))
    store.write("t", spark.range(200_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")).coalesce(1), key=["k"])
    whole = size()
    store.change("t", spark.createDataFrame([(5, "new"), (7, "new")], "k long, v string"), ["k"], spark.createDataFrame([(9,)], "k long"))
    assert size() - whole < whole / 100
    assert store.read("t").count() == 199_999 and store.read("t").where("v = 'new'").count() == 2


def _folder(tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "old.md").write_text("an old file about herons")
    (tmp_path / "files" / "new.md").write_text("a new file about herons")
    when = datetime.datetime(2017, 3, 1, tzinfo=datetime.timezone.utc).timestamp()
    os.utime(tmp_path / "files" / "old.md", (when, when))
    return str(tmp_path / "files")


def test_dates_authors_and_addresses_are_kept(spark, tmp_path):
    store, embedder = Store(spark, str(tmp_path / "store")), models.HashEmbedder(8)
    source = registry.Folder(_folder(tmp_path), "docs")
    corpus.ingest(store, source, embedder, trust.AS_OF)
    rows = {r["source_path"]: r for r in store.read(corpus.FRAGMENTS).collect()}
    assert rows["old.md"]["content_date"] == datetime.datetime(2017, 3, 1) and rows["old.md"]["source_uri"].endswith("/files/old.md")
    found = {r["source_path"]: r["freshness"] for r in corpus.search(store, ["herons"], embedder, 5, trust.AS_OF).collect()}
    assert found == {"old.md": 0.1, "new.md": 1.0}
    # a file that loses its text loses its fragments, others stay
    (tmp_path / "files" / "old.md").write_text("")
    assert corpus.ingest(store, source, embedder, trust.AS_OF)[1] == 0
    assert "old file" not in {r["raw_content"] for r in store.read(corpus.FRAGMENTS).collect()}


def test_dates_of_commits(spark, tmp_path):
    root = _folder(tmp_path)
    run = lambda *a, **env: subprocess.run(["git", "-c", "user.name=Ann", "-c", "user.email=a@x", *a], cwd=root, check=True, capture_output=True, env=os.environ | env)
    run("init", "-q")
    assert registry.Folder(root, "docs").scan(spark).where("author is not null").count() == 0  # no commit yet
    run("add", "new.md")
    run("commit", "-q", "-m", "x", GIT_AUTHOR_DATE="2020-05-06T07:08:09+00:00", GIT_COMMITTER_DATE="2020-05-06T07:08:09+00:00")
    rows = {r["source_path"]: (r["content_date"], r["author"]) for r in registry.Folder(root, "docs").scan(spark).collect()}
    assert rows == {"new.md": (datetime.datetime(2020, 5, 6, 7, 8, 9), "Ann"), "old.md": (datetime.datetime(2017, 3, 1), None)}


def test_dates_of_pdf_files(spark):
    data = b"%PDF-1.4\n1 0 obj\n<< /ModDate (D:20190203040506Z) >>\nendobj\ntrailer\n<< /Info 1 0 R >>\n%%EOF"
    now = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a.pdf", data, now), ("b.pdf", b"no pdf", now), ("c.md", data, now), ("d.PDF", None, None)], "source_path string, raw_content binary, content_date timestamp")
    out = {r["source_path"]: r["content_date"] for r in corpus.pdf_dated(rows).collect()}
    assert out == {"a.pdf": datetime.datetime(2019, 2, 3, 4, 5, 6), "b.pdf": now, "c.md": now, "d.PDF": None}


def test_fragments_without_a_date_age_by_their_ingestion(spark):
    ranked = spark.createDataFrame([(1, 5, 1)], "query_id long, doc_id long, rank long")
    frag = spark.createDataFrame([(5, "i", "s", "p.md", ".md", None, 0.0, "t", datetime.datetime(2017, 1, 1))], "doc_id long, id string, source_name string, source_path string, file_type string, content_date timestamp, confidence_adj double, raw_content string, ingested_at timestamp")
    assert plans.trusted(ranked, frag).first()["freshness"] == 0.1
    assert plans.trusted(ranked, frag.drop("ingested_at")).first()["freshness"] == 0.3


def test_streamed_deletions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([("a", "1", None), ("b", "2", False), (None, "3", False)], "id string, content string, deleted boolean")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    go = lambda: streams.ingest(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), store, "t", f"{tmp_path}/cp").awaitTermination()
    go()
    spark.createDataFrame([("b", None, True), (None, "4", False)], rows.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    go()
    assert rows_of(store.read("t"), "id", "content") == [("a", "1"), (None, "4")]
