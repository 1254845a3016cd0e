"""Stems, pushes, connectors, clustering runs, jobs and evaluation files."""

import json
import random
import re
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.functions import models, stem
from corpusloom.operators import search
from corpusloom.plans import clusters, results
from corpusloom.plans.jobs import Jobs
from corpusloom.schema import fragments
from corpusloom.sources import registry

WORDS = (
    "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional "
    "rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti "
    "sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant "
    "replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll running flies dying yes saying"
)


def test_stems_are_sqlites():
    rng = random.Random(1)
    words = WORDS.split() + ["".join(rng.choice("aeioubcdlnrstyz") for _ in range(rng.randint(3, 6))) + rng.choice(["ing", "ed", "s", "ies", "ational", "ness", "ly", "e", "y", "ll"]) for _ in range(2000)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize = 'porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(words))
    want = dict(con.execute("SELECT doc, term FROM v").fetchall())
    wrong = [(w, stem.stem(w), want[i]) for i, w in enumerate(words) if stem.stem(w) != want[i]]
    assert len(wrong) <= 0.02 * len(words), wrong[:10]
    assert not [x for x in wrong if x[0] in WORDS.split()], wrong
    assert stem.split("Café-crème, naïve_x 12") == ["cafe", "creme", "naive", "x", "12"]


def test_stemmed_search(spark):
    docs = spark.createDataFrame([(1, "The foxes were running"), (2, "A dog runs"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "fox run"), (2, "run")], "query_id long, query string")
    out = {(r["query_id"], r["doc_id"]) for r in search.bm25(docs, q, 5, tokenizer=stem.tokens).collect()}
    assert out == {(1, 1), (2, 1), (2, 2)}


def test_push(spark):
    schema = "id string, source_type string, source_name string, source_path string, raw_content string, checksum string, pos int"
    old = spark.createDataFrame([("x", "web", "s", "p", "old", "1", 0), ("y", "web", "s", "q", "keep", "2", 0), ("z", "web", "s", "r", "gone", "3", 0)], schema)
    rows = spark.createDataFrame([(None, "web", "s", "p", "a", "9", 5), (None, "web", "s", "p", "b", "9", 7), (None, "web", "s", "q", "keep", "2", 8)], schema)
    gone = spark.createDataFrame([("web", "", "r")], "source_type string, source_name string, source_path string")
    out = sorted((r["source_path"], r["raw_content"]) for r in registry.pushed(old, rows, gone).collect())
    assert out == [("p", "a"), ("p", "b"), ("q", "keep")]


def test_connectors(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    (tmp_path / "b.md").write_text("y")
    source = registry.connector("filesystem", root=str(tmp_path), name="n")
    known = source.scan(spark).where("source_path = 'a.md'").select("source_path", "checksum").unionByName(spark.createDataFrame([("c.md", "1")], "source_path string, checksum string"))
    changed, gone = registry.incremental(spark, source, known)
    assert [r["source_path"] for r in changed.collect()] == ["b.md"] and [r["source_path"] for r in gone.collect()] == ["c.md"]
    with pytest.raises(ValueError):
        registry.connector("none")
    docs = registry.connector("table", path="/root/testdata/sf0.001/documents.parquet", name="d", columns={"source_path": "doc_id", "raw_content": "text"})
    assert docs.scan(spark).count() == 200


def test_clustering_run(spark):
    rows = fragments(spark, "/root/testdata/sf0.001").withColumn("embedding", models.embed(F.col("raw_content"), models.HashEmbedder(8)))
    found, units = clusters.run(rows, 4)
    assert found.count() == 200
    got = units.collect()
    assert sum(r["n"] for r in got) == 200 and all(len(r["unit_id"]) == 16 and 0 <= r["overall"] <= 1 and len(r["centroid"]) == 8 for r in got)
    page = clusters.picture(spark.createDataFrame([(1, 0.0, 1.0, 2, "</script>")], "doc_id long, x0 double, x1 double, cluster long, label string"))
    assert page.count("</script>") == 1


def test_jobs():
    jobs = Jobs()
    a = jobs.start("s", lambda stop: stop.wait(5))
    with pytest.raises(RuntimeError):
        jobs.start("s", lambda stop: None)
    b = jobs.start("t", lambda stop: 1 / 0)
    jobs.cancel(a.id)
    for _ in range(100):
        if a.state != "running" and b.state != "running":
            break
        time.sleep(0.05)
    assert (a.state, b.state) == ("cancelled", "failed") and jobs.get(b.id).error and len(jobs.list()) == 2


def test_evaluation_files(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps([{"id": "1", "query": "q", "expected_sources": ["a.md"], "category": "c"}]))
    cases = results.load_testset(spark, f"file://{tmp_path}/cases.json")
    assert cases.first()["expected_sources"] == ["a.md"]
    results.save(cases.select("id", "query"), f"file://{tmp_path}/out")
    assert results.load(spark, f"file://{tmp_path}/out", "id string, query string").first()["query"] == "q"


def test_corpus_from_end_to_end(spark, tmp_path, capsys):
    from corpusloom.__main__ import main

    root, store = tmp_path / "docs", f"file://{tmp_path}/store"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("# Retry\n\n## Backoff\nretry with exponential backoff\n")
    (root / "sub" / "b.py").write_text("def retry():\n    return 1\n\ndef other():\n    return 2\n")

    def run(*args):
        main([store, *args])
        return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    assert run("ingest", str(root), "--name", "n") == [{"changed": 2, "deleted": 0}]
    assert run("ingest", str(root), "--name", "n") == [{"changed": 0, "deleted": 0}]
    found = run("query", "exponential backoff", "--limit", "3")
    assert found[0]["source_path"] == "a.md" and 0 < found[0]["overall"] <= 1
    (root / "a.md").unlink()
    (root / "sub" / "b.py").write_text("def retry():\n    return 3\n")
    assert run("ingest", str(root), "--name", "n") == [{"changed": 1, "deleted": 1}]
    assert [(r["source_name"], r["fragments"]) for r in run("sources")] == [("n", 1)]
    run("export", f"file://{tmp_path}/out")
    assert len((next((tmp_path / "out" / "tensors").glob("part-*.txt"))).read_text().split("\t")) == 64
    run("backup", f"file://{tmp_path}/backup")
    run("restore", f"file://{tmp_path}/backup")
    assert [r["fragments"] for r in run("sources")] == [1]


@pytest.mark.parametrize("name", ["chunk_code", "chunk_config", "chunk_jupyter"])
def test_files_hold_whole_texts(spark, tmp_path, name):
    text = "w0 \"q\" \\ x\nw1 é\n\n" + " ".join(f"w{i}" for i in range(2, 900)) + "\n\n" + "\n".join(f"w{i} and more" for i in range(900, 1200))
    spark.createDataFrame([(1, text, "s"), (2, None, "s"), (3, "one", None)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.QUERIES[name](spark, str(tmp_path)).orderBy("source_path", "idx").collect()
    mine = [r for r in got if r["source_path"].startswith("1.")]
    found = re.findall(r"w\d+", " ".join(r["raw_content"] for r in mine))
    assert found == [f"w{i}" for i in range(1200)]
    assert all(len(r["raw_content"].encode()) <= 2000 for r in mine) and any("part" in r["metadata"] for r in mine)
    assert any("one" in r["raw_content"] for r in got if r["source_path"].startswith("3."))


def test_common_directories_of_all_rows(spark, tmp_path):
    rows = [(1, "en", "s", 10)] * 5 + [(2, "en", "s", 900), (5, "en", "s", 10), (6, "en", "t", 10), (10, "fr", None, 2500), (11, None, "t", 5), (15, "de", "u", None), (None, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["part"]: (r["n"], r["common"]) for r in catalog.QUERIES["common_directories"](spark, str(tmp_path)).collect()}
    want = {}
    for part in (0, 1, 2, 3):
        paths = [f"{lang or 'none'}/{source or 'none'}/{(n or 0) // 1000}/{i}".split("/") for i, lang, source, n in rows if i is not None and i // 5 == part]
        k = 0
        while k < 4 and len({tuple(p[: k + 1]) for p in paths}) == 1:
            k += 1
        want[part] = (len(paths), "/".join(paths[0][:k]))
    assert got == want and want[0] == (6, "en/s/0") and want[1] == (2, "en") and want[2] == (2, "") and want[3] == (1, "de/u/0/15")
