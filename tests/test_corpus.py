"""Sources, chunkers, the store, clusters, evaluation and streams."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import models
from corpusloom.operators import cluster, evaluate, storage
from corpusloom.plans.store import Store
from corpusloom.sources import chunking, files, messages
from corpusloom.streaming import ingest


def test_scan(spark, tmp_path):
    good = {"a.md": "x", "src/_idx.py": "def f(): 1", "src/__init__.py": "", "deep/er/c.txt": "é"}
    bad = {".hidden.md": "x", "node_modules/j.js": "x", "a.min.js": "x", "LICENSE": "x", "p.PNG": "x", "_generated_x.go": "x", "y.generated.ts": "x", ".git/config": "x"}
    for name, text in (good | bad).items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "nul.txt").write_bytes(b"a\0b")
    (tmp_path / "big.txt").write_text("x" * (files.MOST_BYTES + 1))
    out = {r["source_path"]: r for r in files.scan(spark, str(tmp_path), "repo").collect()}
    assert set(out) == set(good)
    assert bytes(out["deep/er/c.txt"]["raw_content"]).decode() == "é" and out["a.md"]["source_name"] == "repo"
    fragments = chunking.to_fragments(files.scan(spark, str(tmp_path), "repo")).collect()
    assert {r["source_path"] for r in fragments} == set(good) and all(len(r["id"]) == 16 for r in fragments)


def test_git_rows(spark):
    rows = spark.createDataFrame([("M", "a", None), ("D", "b", None), ("R090", "c", "d"), ("C75", "e", "f")], "status string, path string, new_path string")
    assert {(r["path"], r["state"]) for r in files.name_status(rows).collect()} == {("a", "changed"), ("b", "deleted"), ("c", "deleted"), ("d", "changed"), ("e", "deleted"), ("f", "changed")}
    one = spark.range(1)
    assert one.select(files.repository_name(F.lit("git@host:owner/name.git"))).first()[0] == "owner/name"
    assert one.select(files.wiki_page(F.lit("wiki/My-Page.md"))).first()[0] == "wiki/My-Page"


def test_messages(spark):
    one = spark.range(1)
    get = lambda c: str(one.select(c).first()[0])
    assert get(messages.wiki_time(F.lit("2024-01-05T08:07:08+02:00")).cast("string")) == "2024-01-05 06:07:08"
    assert get(messages.wiki_time(F.lit("nonsense"))) == "None" and get(messages.chat_time(F.lit("x.1"))) == "None"
    assert get(messages.chat_time(F.lit("60.5")).cast("string")) == "1970-01-01 00:01:00"
    assert get(messages.pdf_time(F.lit("D:20240102030405Z")).cast("string")) == "2024-01-02 03:04:05" and get(messages.pdf_time(F.lit("D:2024")).cast("string")) == "2024-01-01 00:00:00"
    df = spark.createDataFrame([("t", 2, "bo", "y"), ("t", 1, "al", "x"), ("u", 1, None, None)], "th string, n int, who string, text string")
    out = {r["th"]: r for r in messages.threads(df, "th", "n", "who", "text").collect()}
    assert out["t"]["content"] == "al: x\nbo: y\n" and out["t"]["author"] == "al" and out["u"]["content"] == ": \n"


def test_sized_pieces():
    rng = random.Random(1)
    for _ in range(200):
        raw = "".join(rng.choice("ab .\né") for _ in range(rng.randint(0, 400))).encode()
        pieces = chunking.split_sized(raw, 60)
        assert all(len(p) <= 60 for p in pieces)
        assert b"".join(b"".join(pieces).split()) == b"".join(raw.split())
    assert chunking.split_sized(b"x" * 10, 4, 1) == [b"xxxx", b"xxxx", b"xxxx"]


def test_plain_chunks():
    assert chunking.plain(b"  ") == [("", {"offset": "0"})]
    out = chunking.plain(b"one two\n\nthree\n\nfour five six", most=16, overlap=5)
    assert [c for c, _ in out] == ["one two\n\nthree", "three\n\nfour five six"[:0] + "three", "four five six"] or all(len(c.encode()) <= 24 for c, _ in out)
    long = " ".join(f"w{i}." for i in range(2000)).encode()
    pieces = [c for c, _ in chunking.plain(long)]
    assert all(len(p.encode()) <= 2000 for p in pieces) and all(f"w{i}." in " ".join(pieces) for i in range(2000))


def test_markdown_chunks():
    text = b"---\ntitle: x\n---\n# Top\nintro\n## One\nbody\n#### deep\nmore\n### Two\n" + b"z" * 3000
    out = chunking.markdown(text)
    assert out[0][0] == "# Top\nintro" and out[1][0].startswith("## One\n\nbody\n#### deep") and out[1][1]["heading"] == "One"
    assert [m.get("part") for _, m in out[2:]] == ["1", "2"]
    assert chunking.markdown(b"") == [("", {"heading": ""})]


def test_code_chunks():
    out = chunking.code(b"import os\n\nclass A:\n    def f(self):\n        pass\n", "x.py")
    assert [(m["type"], m["name"]) for _, m in out] == [("preamble", ""), ("class", "A"), ("function", "f")]
    out = chunking.code(b"func Go() {}\n\ntype T struct{}\n", "x.go")
    assert [(m["type"], m["name"]) for _, m in out] == [("function", "Go"), ("type", "T")]
    out = chunking.code(b"export default class Foo {\n}\npub", "x.ts")
    assert out[0][1] == {"type": "class", "name": "Foo"}
    assert chunking.code(b"nothing here", "x.rs")[0][0] == "nothing here"
    out = chunking.code(b"public class K {\n  public int size() { return 1; }\n}", "K.java")
    assert [(m["type"], m["name"]) for _, m in out] == [("class", "K"), ("function", "size")]


def test_config_chunks():
    assert [(c, m["key"]) for c, m in chunking.config(b"b: 2\na:\n  x: 1\n", "x.yaml")] == [("a:\n    x: 1", "a"), ("b: 2", "b")]
    assert [m["key"] for _, m in chunking.config(b'{"z": 1, "y": [1, 2]}', "x.json")] == ["y", "z"]
    assert [m["section"] for _, m in chunking.config(b"k=0\n[a]\nk=1\n[[b]]\nk=2", "x.toml")] == ["", "a", "[b"]
    assert [m["key"] for _, m in chunking.config(b"A=1\nB=2\n\n# note\nC: 3", "x.env")] == ["A", "C"]
    assert chunking.config(b"{broken", "x.json")[0][0] == "{broken"


def test_notebook_chunks():
    cells = [{"cell_type": "markdown", "source": ["# T"]}, {"cell_type": "code", "source": ["a", "=1"]}, {"cell_type": "code", "source": []}, {"cell_type": "code", "source": ["b"]}]
    out = chunking.notebook(json.dumps({"cells": cells}).encode())
    assert [(c, m["type"], m["cell"]) for c, m in out] == [("# T", "markdown", "1"), ("a=1\n\nb", "code", "2")]
    with pytest.raises(ValueError):
        chunking.notebook(b'{"cells": [{"cell_type": "code", "source": "x"}]}')


def test_refused_documents_are_plain(spark):
    df = spark.createDataFrame([("a.ipynb", "not json"), ("b.txt", None)], "source_path string, raw_content string")
    out = {r["source_path"]: r["chunk"]["content"] for r in chunking.chunks(df).collect()}
    assert out == {"a.ipynb": "not json", "b.txt": ""}


def test_store_and_changes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, content string")
    store.write("t", old)
    store.update("t", lambda t: storage.upsert(t, spark.createDataFrame([(2, "c"), (3, "d")], "id long, content string")))
    assert sorted(map(tuple, store.read("t").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    store.backup("t", f"file://{tmp_path}/copy")
    store.write("t", old.limit(0))
    store.restore("t", f"file://{tmp_path}/copy")
    assert store.read("t").count() == 3
    with pytest.raises(KeyError):
        store.read("none")
    scan = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", "3")], "source_path string, checksum string")
    known = spark.createDataFrame([("p", "1"), ("q", "9"), ("s", "4")], "source_path string, checksum string")
    assert {(r["source_path"], r["state"]) for r in storage.changes(scan, known).collect()} == {("p", "unchanged"), ("q", "changed"), ("r", "changed"), ("s", "deleted")}


def test_kmeans_and_pca(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(c, 0.1, (60, 4)) for c in (-3, 0, 3)])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>").repartition(4)
    found, centroids = cluster.kmeans(df, 3)
    labels = {r["vec_id"]: r["cluster"] for r in found.collect()}
    assert len({labels[i] for i in range(60)}) == len({labels[i] for i in range(60, 120)}) == 1 and len(set(labels.values())) == 3
    out = np.array([(r["vec_id"], r["x0"], r["x1"]) for r in cluster.pca(df, 2).orderBy("vec_id").collect()])
    centred = points - points.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(out[:, 1]), np.abs(centred @ axes[0]), atol=1e-6) and abs(out[:, 1].mean()) < 1e-9
    assert cluster.default_k(50) == 5 and cluster.default_k(1) == 1
    same, _ = cluster.kmeans(df.limit(3), 3)
    assert same.count() == 3


def test_kmeans_seeds_rare_clusters(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(0, 0.1, (20_000, 2)), [[1000, 0], [1000, 90], [1090, 0], [1090, 90]]])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    seen = []
    for parts in (3, 7):
        found, _ = cluster.kmeans(df.repartition(parts), 5)
        labels = {r["vec_id"]: r["cluster"] for r in found.collect()}
        assert len({labels[i] for i in range(20_000, 20_004)} | {labels[0]}) == 5
        seen.append(labels)
    assert seen[0] == seen[1]
    alike = spark.createDataFrame([(i, [1.0 * (i % 2), 0.3]) for i in range(50)], "vec_id long, embedding array<double>")
    assert len({(r["cluster"], r["vec_id"] % 2) for r in cluster.kmeans(alike, 4)[0].collect()}) == 2


def test_topics(spark):
    rows = [(1, "s", f"docs/api/v{i}.md") for i in range(8)] + [(1, "t", "other/x.go")] * 2 + [(2, "a", "x.go"), (2, "b", "y.go"), (2, "c", "z.md")] + [(3, "a", "m/x.go"), (3, "b", "n/x.md"), (3, "c", "o/y.md")]
    df = spark.createDataFrame(rows, "cluster long, source_name string, source_path string")
    got = {r["cluster"]: r["topic"] for r in cluster.topics(df).collect()}
    assert got == {1: "s: docs/api", 2: "root .go", 3: "m .md"}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, False, None), (1, 2, True, "a"), (1, 3, True, "a"), (1, 7, True, "b"), (2, 1, False, None), (4, 1, False, None)], "query_id long, rank long, relevant boolean, found string")
    queries = spark.createDataFrame([(1, "x", 2), (2, "x", 1), (3, "y", 0), (4, "y", 0)], "query_id long, category string, n_expected int")
    out = {r["query_id"]: r for r in evaluate.per_query(ranked, queries).collect()}
    assert (out[1]["recall_5"], out[1]["recall_10"], out[1]["precision_5"], out[1]["mrr"], out[1]["hit_1"], out[1]["hit_3"]) == (0.5, 1.0, 0.666667, 0.5, 0.0, 1.0)
    assert (out[2]["recall_5"], out[2]["mrr"], out[2]["precision_5"]) == (0, 0, 0)
    assert (out[3]["recall_5"], out[3]["precision_5"], out[3]["mrr"], out[3]["hit_5"]) == (1, 1, 1, 1) and out[4]["precision_5"] == 0
    assert all(0 <= v <= 1 for r in out.values() for v in r[2:])
    total = [r for r in evaluate.summary(evaluate.per_query(ranked, queries)).collect() if r["category"] is None][0]
    assert total["n"] == 4 and total["mrr"] == 0.62 or total["mrr"] == 0.63


def test_stream_is_batch(spark, tmp_path):
    rows = [(f"k{i % 7}", f"v{i}", i % 5 == 4) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, content string, deleted boolean")
    for i in range(4):
        df.where(F.col("content").isin([f"v{k}" for k in range(i * 10, i * 10 + 10)])).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    store = Store(spark, f"file://{tmp_path}/store")
    want = {}
    for i in range(4):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / f"in/{i}"))
        ingest.ingest(stream, store, "t", str(tmp_path / f"cp{i}")).awaitTermination()
        part = rows[i * 10 : i * 10 + 10]
        gone = {k for k, _, d in part if d}
        want = {k: v for k, v in want.items() if k not in gone}
        for k, v, d in part:
            if not d and k not in gone:
                want[k] = max(v, want[k]) if k in {p[0] for p in part[: part.index((k, v, d))]} and k in want else v
    assert dict(map(tuple, store.read("t").collect())) == want


def test_chunks_are_held_for_few_documents():
    batch = pa.RecordBatch.from_arrays([pa.array(range(150)), pa.array(["a.txt"] * 150), pa.array([f"text {i}" for i in range(150)])], ["row", "p", "c"])
    got = [*chunking._chunked(iter([batch]), 100)]
    assert [b.num_rows for b in got] == [64, 64, 22] and [x for b in got for x in b.column(0).to_pylist()] == [*range(150)]
    assert [c["content"] for b in got for x in b.column(1).to_pylist() for c in x] == [f"text {i}" for i in range(150)]


def test_chunks_carry_only_what_stays(spark):
    docs = spark.createDataFrame([(1, "a.txt", "one")], "doc_id long, source_path string, raw_content string")
    assert chunking.chunks(docs, columns=["doc_id"]).columns == ["doc_id", "idx", "chunk"] and chunking.chunks(docs).columns == [*docs.columns, "idx", "chunk"]


def test_texts_are_embedded_once_and_few_at_a_time():
    class Probe(models.HashEmbedder):
        calls = []

        def embed(self, texts):
            self.calls.append(texts)
            return super().embed(texts)

    texts = [f"t{i % 5}" if i % 7 else None for i in range(23)] + [f"u{i}" for i in range(9)] + ["t1"]
    probe = Probe(4)
    got = models._vectors(pa.array(texts), probe, 3).to_pylist()
    assert got == models.HashEmbedder(4).embed([t or "" for t in texts]) and max(map(len, probe.calls)) <= 3
    assert sorted(t for c in probe.calls for t in c) == sorted({t or "" for t in texts}) and models._vectors(pa.array([], pa.string()), probe, 3).to_pylist() == []
