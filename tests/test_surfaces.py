"""Sources behind a client, the answering engine, caches, the stored index, enrichment, serving and commands."""

import json
import subprocess
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from corpusloom import __main__ as commands
from corpusloom import serve, settings
from corpusloom.functions import models
from corpusloom.functions import text as X
from corpusloom.operators import search
from corpusloom.plans import answers, clusters, corpus, enrichment, evaluation, query, results
from corpusloom.plans.store import Store
from corpusloom.schema import fragments
from corpusloom.sources import chunking, files, git, messages, registry, remote
from corpusloom.streaming import ingest as streams

SF = "/root/testdata/sf0.001"
AS_OF = "2024-02-01 00:00:00"


def _value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_scalar_rules(spark):
    of = lambda f, *x: _value(spark, f(*map(F.lit, x)))
    assert [of(X.age, d) for d in (0, 1, 29, 30, 59, 60, 359, 360, 719, 720)] == ["today", "1 day", "29 days", "1 month", "1 month", "2 months", "11 months", "1 year", "1 year", "2 years"]
    assert [of(X.mask, s) for s in ("short", "12345678", "1234567890")] == ["****", "12345678****", "12345678****"]
    assert [of(X.is_secret, k) for k in ("api_key", "TOKENS", "path")] == [True, True, False]
    assert of(X.source_label, "slack", "ops") == "Slack channels: ops" and of(X.source_label, "ftp", "x") == "ftp: x"
    assert [_value(spark, X.first_bytes(F.lit("aé日x"), n)) for n in (1, 2, 3, 5, 6, 7)] == ["a", "a", "aé", "aé", "aé日", "aé日x"]
    assert of(X.strip_meta, "a b \n---KB_META---\n{}") == "a b" and of(X.strip_meta, " as it is ") == " as it is "
    assert of(files.wiki_page, "sub/My.Page.md") == "sub/My.Page" and of(files.wiki_page, "a.b/Page") == "a.b/Page"
    assert [str(of(messages.wiki_time, t)) for t in ("2024-01-05T06:07:08Z", "2024-01-05T08:07:08.250+02:00", "2024-01-05T06:07:08.000+0000", "2024-01-05T04:07:08.000-0200", "2024-01-05 06:07:08")] == [
        "2024-01-05 06:07:08", "2024-01-05 06:07:08.250000", "2024-01-05 06:07:08", "2024-01-05 06:07:08", "None"
    ]


def test_changes_know_nulls(spark):
    from corpusloom.operators import storage

    seen = spark.createDataFrame([("a", None), ("b", "1"), ("c", "2"), ("d", None)], "source_path string, checksum string")
    known = spark.createDataFrame([("a", None), ("b", "1"), ("c", "3"), ("e", "4"), ("f", None)], "source_path string, checksum string")
    assert sorted(map(tuple, storage.changes(seen, known).collect())) == [("a", "unchanged"), ("b", "unchanged"), ("c", "changed"), ("d", "changed"), ("e", "deleted"), ("f", "deleted")]


def test_chunks_of_scripts_and_blanks():
    js = b"import a from 'a'\nconst b = require('b')\nfunction build() { return 'class x' }\nclass Car {}\nexport const go = 1\n"
    assert [(t, m["type"], m["name"]) for t, m in chunking.code(js, "x.js")] == [
        ("import a from 'a'\nconst b = require('b')", "preamble", ""), ("function build() { return 'class x' }", "function", "build"), ("class Car {}", "class", "Car"), ("export const go = 1", "function", "go")
    ]
    assert chunking._imports(["import a", "const x = 1", "import b", "go()", "import c"], ".ts") == "import a\nimport b"
    assert chunking.plain("à".encode())[0][0] == "à" and chunking.plain("\u2003x à\xa0".encode())[0][0] == "x à"
    body = ("One two. " * 400).encode()
    pieces = chunking.split_sized(body, 2000, 150)
    assert all(len(p) <= 2000 for p in pieces) and pieces[0].endswith(b"two.") and pieces[1].startswith(body[len(pieces[0]) - 150 : len(pieces[0]) - 100].strip())
    assert [t for t, _ in chunking.markdown(b"---\na: 1\n---\nintro\n## A\ntext\n# not\n### B\n")] == ["intro", "## A\n\ntext\n# not", "### B"]


@pytest.fixture()
def repository(tmp_path):
    root = tmp_path / "owner" / "repo.git"
    root.mkdir(parents=True)
    run = lambda *a: subprocess.run(["git", "-c", "user.name=Ann", "-c", "user.email=a@x", *a], cwd=root, check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q", "-b", "main")
    (root / "docs").mkdir()
    (root / "docs" / "One.md").write_text("one")
    (root / "two.py").write_text("two")
    (root / "old.md").write_text("a text that is long enough to be found again under another name\n" * 3)
    (root / "x.png").write_bytes(b"\x89PNG")
    run("add", "-A")
    run("commit", "-q", "-m", "first")
    return root, run


def test_git(spark, tmp_path, repository):
    root, run = repository
    source = registry.connector("git", url=f"file://{root}", work=str(tmp_path / "work"))
    first = source.fetch(spark)
    assert source.name == "owner/repo" and first.mode == "full" and first.head == run("rev-parse", "HEAD")
    assert sorted((r["source_path"], bytes(r["raw_content"])[:3]) for r in first.documents.collect()) == [("docs/One.md", b"one"), ("old.md", b"a t"), ("two.py", b"two")]
    (root / "docs" / "One.md").write_text("one more")
    (root / "two.py").unlink()
    run("mv", "old.md", "new.md")
    run("add", "-A")
    run("commit", "-q", "-m", "second")
    run("config", "uploadpack.allowFilter", "true")
    source.last_commit = first.head
    second = source.fetch(spark)
    assert second.mode == "diff" and sorted(r["source_path"] for r in second.documents.collect()) == ["docs/One.md", "new.md"]
    assert sorted(r["source_path"] for r in second.deleted.collect()) == ["old.md", "two.py"]
    source.last_commit = "0" * 40
    assert source.fetch(spark).mode == "full"
    pinned = git.Git(f"file://{root}", str(tmp_path / "work"), commit=first.head).fetch(spark)
    assert pinned.mode == "commit" and pinned.documents.count() == 3 and pinned.documents.first()["source_uri"].startswith(f"file://{root}"[:-4] + f"/blob/{first.head}/")
    changed = {r["path"]: r["author"] for r in git.log(spark, str(root)).collect()}
    assert set(changed) >= {"docs/One.md", "new.md", "two.py", "x.png"} and set(changed.values()) == {"Ann"}


def test_wiki_address():
    wiki = git.Wiki("https://host/owner/repo", "work")
    assert wiki.url == "https://host/owner/repo.wiki.git" and wiki.name == "owner/repo" and wiki.base == "https://host/owner/repo/wiki"


def test_chat_and_pages(spark, tmp_path):
    m = lambda ts, text, **more: {"ts": ts, "user": "u" + ts[-1], "text": text, **more}
    history = {"": ([m("1700000000.1", "day one"), m("1700000001.2", "asks", reply_count=2)], "n/2"), "n%2F2": ([m("1700000002.3", "also", thread_ts="1700000001.2"), m("1700090000.4", "day two")], "")}
    waits, tried = [], []

    def get(url):
        tried.append(url)
        if len(tried) == 2:
            return 429, {"Retry-After": "7"}, {}
        if "info" in url:
            return 200, {}, {"ok": True, "channel": {"name": "general"}}
        if "replies" in url:
            return 200, {}, {"ok": True, "messages": [m("1700000001.2", "asks"), m("1700000003.5", "answers")]}
        rows, cursor = history[url.partition("cursor=")[2]]
        return 200, {}, {"ok": True, "messages": rows, "response_metadata": {"next_cursor": cursor}}

    chat = remote.Chat(get, "https://c", ["C1"], str(tmp_path / "w"), sleep=waits.append)
    out = {r["source_path"]: r["raw_content"] for r in chat.scan(spark).collect()}
    assert waits == [7] and out == {
        "general/2023-11-14": "[2023-11-14T22:13:20Z] u1: day one\n", "general/thread-1700000001.2": "[2023-11-14T22:13:21Z] u2: asks\n[2023-11-14T22:13:23Z] u5: answers\n",
        "general/2023-11-15": "[2023-11-15T23:13:20Z] u4: day two\n",
    }
    with pytest.raises(RuntimeError):
        remote.asked(lambda url: (429, {}, {}), "u", waits.append)
    assert waits[1:] == [1] * 5

    def pages(url):
        page = lambda k: {"id": str(k), "body": {"storage": {"value": f"<p>{k}</p>"}}, "version": {"when": "2024-01-05T06:07:08.000Z", "by": {"displayName": "Ann"}}}
        return 200, {}, {"results": [page(1)], "_links": {"next": "/more"}} if "start=0" in url else {"results": [page(2)]}

    rows = remote.Pages(pages, "https://w", "S", str(tmp_path / "w")).scan(spark).orderBy("source_path").collect()
    assert [(r["source_path"], r["raw_content"], r["source_uri"], str(r["content_date"])) for r in rows] == [(str(k), f"<p>{k}</p>", f"https://w/wiki/spaces/S/pages/{k}", "2024-01-05 06:07:08") for k in (1, 2)]


def test_settings():
    found, layers = settings.resolve({"A": "1", "B": "2", "C": "3", "D": "4"}, [("user", "# x\nA='u'\nB=u\n"), ("none", None), ("flag", "B = \"f\"\nD=\nbad line")], {"C": "e", "OTHER": "x"})
    assert {k: (s.value, s.origin) for k, s in found.items()} == {"A": ("u", "user"), "B": ("f", "flag"), "C": ("e", "env"), "D": ("4", "flag")}
    assert layers == [("user", True), ("none", False), ("flag", True)]


class Flaky:
    dim = 2

    def __init__(self):
        self.calls = []

    def embed(self, texts):
        self.calls.append([*texts])
        if len(self.calls) < 3 or "bad" in texts and len(texts) > 1:
            raise RuntimeError
        return [[1.0, 0.0] for _ in texts]


def test_embedders(spark):
    flaky = Flaky()
    assert models.Retrying(flaky, (0, 0)).embed(["a"]) == [[1.0, 0.0]] and len(flaky.calls) == 3
    assert models.Retrying(flaky, (0, 0)).embed(["a", "bad"]) == [[1.0, 0.0]] * 2
    inner = Flaky()
    inner.calls = [[]] * 3
    kept = models.Caching(inner, 2)
    kept.embed(["a", "b"])
    kept.embed(["b", "a", "c", "c"])
    kept.embed(["a"])
    assert inner.calls[3:] == [["a", "b"], ["c"], ["a"]]
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, " "), (4, None)], "i long, text string")
    out = {r["i"]: r["embedding"] for r in models.embedded(rows, "text", models.HashEmbedder(4)).collect()}
    assert out[1] == out[2] and len(out[1]) == 4 and out[3] is None and out[4] is None
    back = rows.select(models.bytes_vector(models.vector_bytes(F.array(F.lit(0.5), F.lit(-2.0)))).alias("v")).first()["v"]
    assert back == [0.5, -2.0]


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red docker-compose fox"), (2, "docker then compose"), (3, "fox fox red"), (4, ""), (5, None), (6, "red red hat")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "fox"), (2, "docker-compose"), (3, "red fox ?"), (4, "none"), (5, "red")], "query_id long, query string")
    index = search.Stored(Store(spark, str(tmp_path)))
    assert index.fill(docs) and not index.fill(docs)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(index.search(asked, 5)) == rows(search.bm25(docs, asked, 5))
    keep = docs.where("doc_id in (3, 6)")
    assert rows(index.search(asked, 5, keep=keep)) == rows(search.bm25(docs, asked, 5, keep=F.col("doc_id").isin(3, 6)))
    new = spark.createDataFrame([(2, "a red fox"), (7, "fox")], "doc_id long, text string")
    index.update(new, spark.createDataFrame([(3,)], "doc_id long"))
    now = docs.where("doc_id not in (2, 3)").unionByName(new)
    assert rows(index.search(asked, 5)) == rows(search.bm25(now, asked, 5))
    embedded = asked.withColumn("embedding", F.lit(None).cast("array<float>"))
    assert rows(query.hybrid(now.withColumnRenamed("text", "raw_content"), embedded, 5, postings=index)) == rows(query.hybrid(now.withColumnRenamed("text", "raw_content"), embedded, 5))


def _engine(spark, model, **options):
    embedder = models.HashEmbedder(8)
    rows = fragments(spark, SF).where("doc_id < 60").withColumn("embedding", models.embed(F.col("raw_content"), embedder)).persist()
    return answers.Engine(rows, embedder, model, as_of=AS_OF, **options), rows


def test_engine(spark, tmp_path):
    said = []

    def model(prompt):
        import re

        return "1. other words\n- more words" if prompt.startswith("Rephrase") else "It is " + " ".join(re.findall(r"^\[[a-f0-9]{16}\]", prompt, re.M)[:1]) + "\n---KB_META---{}"

    cache = answers.Cache(Store(spark, str(tmp_path)))
    engine, rows = _engine(spark, model, cache=cache)
    question = [{"role": "user", "content": rows.first()["raw_content"][:40]}]
    out = engine.answer(question)
    assert len(out["sources"]) == 1 and out["content"] == f"It is [{out['sources'][0]['id']}]" and 0 < out["overall"] <= 1
    engine.model = lambda prompt: said.append(prompt) or "never"
    assert engine.answer(question) == out and not said
    cache.fast.held.clear()
    cache.memory.held.clear()
    engine.model = model
    assert engine.answer(question) == out and cache.memory.held  # from the table, and kept in memory again
    only = engine.raw(question, sources=["src1"])["fragments"]
    assert only and {r["source_name"] for r in only} == {"src1"}
    local = engine.local(question)
    assert len(local["sources"]) <= 5 and local["overall"] > 0
    empty = answers.Engine(rows.limit(0), engine.embedder, model, as_of=AS_OF).answer(question)
    assert empty["content"] == query.EMPTY and empty["sources"] == [] and empty["overall"] == 0
    for bad in ([], [{"role": "assistant", "content": "x"}]):
        with pytest.raises(ValueError):
            engine.raw(bad)


def test_cache_tiers():
    cache = answers.Cache()
    cache.put("k", "q", False, "s", "a", 0)
    assert cache.quick("k", 120) == "a" and cache.quick("k", 121) is None
    assert cache.get("k", "s", 600) == "a" and cache.get("k", "t", 1) is None and cache.get("k", "s", 601) is None


def test_cache_table_is_pruned(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    cache = answers.Cache(store)
    for k in range(10):
        cache.put(f"k{k}", "q", False, "s", "a", 1000 * k)
    assert sorted(r["cache_key"] for r in store.read(answers.TABLE).collect()) == ["k6", "k7", "k8", "k9"]


def test_expansions_lists(spark):
    docs = fragments(spark, SF)
    hints = spark.createDataFrame([(1, 1, "[a] b"), (1, 2, "[c] d")], "query_id long, rank int, hint string")
    asked = spark.createDataFrame([(1, "what"), (2, "fails")], "query_id long, query string")

    def model(prompt):
        if prompt.endswith("fails"):
            raise RuntimeError
        return prompt.count("[") * "1. x\n"

    out = query.expanded(asked, hints, model, models.HashEmbedder(4)).collect()
    assert [(r["query_id"], r["n"], r["query"], len(r["embedding"])) for r in out] == [(1, 1, "x", 4), (1, 2, "x", 4)]
    lists = spark.createDataFrame([(1, 3, 0, 1), (1, 3, 1, 1), (1, 4, 1, 2)], "query_id long, doc_id long, list_id int, rank int")
    assert [r["rank"] for r in query.scouted(docs, lists).orderBy("rank").collect()] == [1, 2]


def test_enrichment_again(spark):
    schema = "id string, source_type string, source_path string, raw_content string, idx int, enriched_content string, enrichment_model string, enrichment_version string, embedding array<float>"
    rows = [("a", "t", "p", "one", 0, "E", "m", "v2", [1.0, 0.0]), ("b", "t", "p", "two", 1, None, None, None, [1.0, 0.0]), ("c", "t", "p", "three", 2, "old", "m", "v1", [1.0, 0.0])]
    table = spark.createDataFrame(rows, schema)
    out = {r["id"]: r for r in enrichment.again(table, lambda p: "after" if "After" in p else "before" if "Before" in p else "alone", "m", models.HashEmbedder(2)).collect()}
    assert [out[k]["enriched_content"] for k in "abc"] == ["E", "two\n\nafter", "three\n\nbefore"]  # b and c are each other's context, a is none
    assert out["a"]["embedding"] == [1.0, 0.0] and out["b"]["embedding"] != [1.0, 0.0]


def test_evaluation_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "x/a.md", "Alpha text", "s", 0.5, 0.3, 0.5, 0.6, 0.5), (1, 2, "x/b.md", "beta", "s", 0.5, 0.3, 0.5, 0.6, 0.5)], "query_id long, rank int, source_path string, raw_content string, source_name string, freshness double, corroboration double, consistency double, authority double, overall double")
    cases = spark.createDataFrame([(1, "c", ["b.md", "z.md"], ["ALPHA", "beta"], ("A.MD", "alpha")), (2, "c", [], [], ("", ""))], "query_id long, category string, expected_sources array<string>, expected_content_contains array<string>, expected_top_result struct<source_contains: string, content_contains: string>")
    each = evaluation.run(cases, rows)
    got = {r["query_id"]: r for r in each.collect()}
    assert (got[1]["recall_5"], got[1]["precision_5"], got[1]["mrr"], got[1]["hit_1"], got[1]["hits"], got[1]["content_match"], got[1]["top_match"]) == (0.5, 0.5, 0.5, 0.0, ["b.md"], True, True)
    assert got[2]["recall_5"] == 1.0 and got[2]["hits"] == [] and got[2]["top_match"] is None and got[2]["avg_confidence"] == 0
    results.save_summary(evaluation.summary(each), str(tmp_path / "s"), "now")
    line = json.loads(spark.read.text(str(tmp_path / "s")).first()[0])
    assert line["test_count"] == 2 and line["hit_3"] == 1.0 and line["categories"][0]["category"] == "c"


def _stored(spark, tmp_path):
    (tmp_path / "files" / "sub").mkdir(parents=True)
    (tmp_path / "files" / "a.md").write_text("alpha words")
    (tmp_path / "files" / "sub" / "b.md").write_text("beta words")
    store, embedder = Store(spark, str(tmp_path / "store")), models.HashEmbedder(8)
    corpus.ingest(store, registry.Folder(str(tmp_path / "files"), "docs"), embedder, AS_OF)
    return store, embedder


def test_corpus_sources(spark, tmp_path):
    store, embedder = _stored(spark, tmp_path)
    corpus.describe(store, "filesystem", "docs", "some files")
    with pytest.raises(ValueError):
        corpus.describe(store, "filesystem", "docs", "other")
    corpus.describe(store, "filesystem", "docs", "other", force=True)
    assert corpus.source(store, "filesystem", "docs")["description"] == "other" and corpus.source(store, "x", "y") is None
    path = str(tmp_path / "sources.json")
    corpus.export_sources(store, path)
    corpus.remove(store, "filesystem", "docs")
    assert store.read(corpus.FRAGMENTS).count() == 0
    corpus.import_sources(store, path)
    assert corpus.source(store, "filesystem", "docs")["config"] == {}
    assert corpus.info(store, embedder)["fragments"] == 0
    corpus.ingest(store, registry.Folder(str(tmp_path / "files"), "docs"), embedder, AS_OF)
    assert corpus.enrich(store, lambda p: "zebra", "m", embedder) == 2 and corpus.enrich(store, lambda p: "never", "m", embedder) == 0
    assert corpus.search(store, ["zebra"], embedder, 5, AS_OF).count() == 2 and {r["enriched_content"] for r in store.read(corpus.FRAGMENTS).collect()} == {"alpha words\n\nzebra", "beta words\n\nzebra"}
    assert [r["source_path"] for r in files.scan(spark, str(tmp_path / "files"), only=["a.md", "none.md"]).collect()] == ["a.md"]
    rounds = iter([True, True, True, False])
    changes = iter([lambda: None, lambda: (tmp_path / "files" / "c.md").write_text("c"), lambda: (tmp_path / "files" / "a.md").unlink()])

    def wait():
        go = next(rounds)
        if go:
            next(changes)()
        return go

    assert corpus.watch(store, registry.Folder(str(tmp_path / "files"), "docs"), embedder, lambda: AS_OF, wait) == [(1, 0), (0, 1)]


def test_units(spark, tmp_path):
    rows = fragments(spark, SF).where("doc_id < 40").withColumn("embedding", models.embed(F.col("raw_content"), models.HashEmbedder(8))).persist()
    found, units = clusters.run(rows, 3)
    store = Store(spark, str(tmp_path))
    clusters.store(units, store, AS_OF)
    clusters.store(units, store, AS_OF)
    got = store.read(clusters.UNITS).collect()
    assert len(got) == units.count() and all(r["fragment_ids"] == sorted(r["fragment_ids"]) and len(r["fragment_ids"]) == r["n"] for r in got)
    ids = clusters.members_of(store, [got[0]["unit_id"]])
    assert [r["fragment_id"] for r in ids.collect()] == got[0]["fragment_ids"]
    points = clusters.points(rows, found, units, 3)
    assert points.count() == rows.count() and {"x0", "x1", "x2", "preview"} <= set(points.columns)
    assert clusters.picture(points).count("[") > rows.count()


def test_streamed_folder(spark, tmp_path):
    (tmp_path / "files" / "node_modules").mkdir(parents=True)
    (tmp_path / "files" / "a.md").write_text("alpha")
    (tmp_path / "files" / "node_modules" / "x.md").write_text("no")
    (tmp_path / "files" / "bin.md").write_bytes(b"a\0b")
    store = Store(spark, str(tmp_path / "store"))
    run = lambda: streams.ingest_documents(streams.folder_stream(spark, str(tmp_path / "files"), "f"), store, models.HashEmbedder(4), str(tmp_path / "cp"), AS_OF).awaitTermination()
    run()
    assert [r["source_path"] for r in store.read("fragments").collect()] == ["a.md"]
    (tmp_path / "files" / "b.md").write_text("beta")
    run()
    assert sorted(r["source_path"] for r in store.read("fragments").collect()) == ["a.md", "b.md"]


def test_batches_of_pushes(spark):
    rows = spark.createDataFrame([(k, "x" * 100) for k in range(10)], "pos long, content string")
    assert {r["batch"] for r in registry.batches(rows, 10_000).collect()} == {0}
    got = [r["batch"] for r in registry.batches(rows, 400).orderBy("pos").collect()]
    assert got == [k // 3 for k in range(10)]
    gone = spark.createDataFrame([("t", "n", "p")], "source_type string, source_name string, path string")
    bodies = [json.loads(b) for b in registry.pushes(rows, gone, 400)]
    assert [len(b["fragments"]) for b in bodies] == [3, 3, 3, 1] and [len(b["deleted"]) for b in bodies] == [1, 0, 0, 0]
    assert json.loads(next(registry.pushes(rows.limit(0), gone)))["deleted"][0]["path"] == "p"


def test_serving(spark, tmp_path):
    store, embedder = _stored(spark, tmp_path)
    service = serve.Service(store, embedder, lambda: AS_OF, lambda p: "an answer")
    server = serve.http(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, body=None):
        data = None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data), timeout=120) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    try:
        user = [{"role": "user", "content": "alpha words"}]
        assert ask("/v1/health") == (200, '{"status": "ok"}')
        raw = json.loads(ask("/v1/query", {"messages": user, "mode": "raw"})[1])
        assert {r["source_path"] for r in raw["fragments"]} == {"a.md", "sub/b.md"}
        said = json.loads(ask("/v1/query", {"messages": user, "no_expand": True})[1])
        assert said["content"] == "an answer" and len(said["sources"]) == 2
        events = ask("/v1/query", {"messages": user, "mode": "local", "stream": True})[1]
        assert events.startswith("data: ") and '"type": "done"' in events
        assert ask("/v1/query", {"messages": []})[0] == 400 and ask("/no")[0] == 404
        new = {"source_type": "web", "source_name": "w", "source_path": "p", "content": "pushed", "checksum": "1"}
        assert json.loads(ask("/v1/ingest", {"fragments": [new]})[1]) == {"ingested": 1, "skipped": 0}
        assert json.loads(ask("/v1/ingest", {"fragments": [new], "deleted": [{"source_type": "filesystem", "path": "a.md"}]})[1]) == {"ingested": 0, "skipped": 1}
        assert sorted(json.loads(x)["source_path"] for x in ask("/v1/export")[1].splitlines()) == ["p", "sub/b.md"]
        assert json.loads(ask("/v1/sources")[1])[0]["source_name"] == "docs"
        assert 'queries_total{mode="raw"} 1' in ask("/metrics")[1]
    finally:
        server.shutdown()
    calls = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "list-sources"}},
             {"id": 4, "method": "tools/call", "params": {"name": "query", "arguments": {}}}, {"id": 5, "method": "prompts/get"}, {"id": 6, "method": "no"}]
    out = {r["id"]: r for r in map(json.loads, serve.rpc(service, map(json.dumps, calls)))}
    assert sorted(out) == [1, 2, 3, 4, 5, 6] and [t["name"] for t in out[2]["result"]["tools"]] == ["query", "list-sources"]
    assert "docs" in out[3]["result"]["content"][0]["text"] and out[4]["result"]["isError"] and out[6]["error"]["code"] == -32601


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.md").write_text("alpha words here")
    at = f"file://{tmp_path}/store"
    run = lambda *a: (commands.main([at, *map(str, a)]), capsys.readouterr().out)[1]
    assert json.loads(run("ingest", tmp_path / "files", "--name", "docs")) == {"changed": 1, "deleted": 0}
    assert json.loads(run("query", "alpha"))["source_path"] == "a.md"
    assert json.loads(run("chat", "alpha"))["fragments"][0]["source_path"] == "a.md"
    run("sources", "describe", "filesystem/docs", "mine")
    assert json.loads(run("sources"))["description"] == "mine"
    assert json.loads(run("cluster", "--k", 1, "--picture", tmp_path / "p.html"))["n"] == 1 and (tmp_path / "p.html").stat().st_size
    (tmp_path / "t.json").write_text(json.dumps([{"id": "1", "query": "alpha", "expected_sources": ["a.md"], "category": "c"}]))
    assert json.loads(run("eval", tmp_path / "t.json", tmp_path / "r"))["hit_1"] == 1.0
    assert run("version").strip() == serve.VERSION and "CORPUSLOOM_LIMIT" in run("config") and json.loads(run("info"))["fragments"] == 1


def _pdf(objects, streams=()):
    """A file of objects by number; streams: numbers whose content is compressed."""
    import zlib

    out = b"%PDF-1.5\n"
    for number, (info, content) in objects.items():
        out += f"{number} 0 obj\n".encode()
        if content is None:
            out += info
        else:
            body = zlib.compress(content) if number in streams else content
            more = b" /Filter /FlateDecode" if number in streams else b""
            out += b"<< " + info + b" /Length " + str(len(body)).encode() + more + b" >>\nstream\n" + body + b"\nendstream"
        out += b"\nendobj\n"
    return out + b"trailer << /Root 1 0 R /Info 9 0 R >>\n%%EOF"


def test_pdf(spark):
    from corpusloom.sources import pdf

    cmap = b"begincmap 1 beginbfchar <0041> <00E9> endbfchar 1 beginbfrange <0042> <0044> <0062> <0050> <0051> [<0078> <0079>] endbfrange endcmap"
    first = b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>"
    second = b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R] >>"
    packed = f"3 0 10 {len(first) + 1} ".encode() + first + b" " + second
    offset = packed.index(first)
    objects = {
        1: (b"<< /Type /Catalog /Pages 2 0 R >>", None),
        2: (b"<< /Type /Pages /Kids [3 0 R 10 0 R] /Count 2 /Resources << /Font << /F1 5 0 R /F2 7 0 R >> >> >>", None),
        4: (b"", b"BT /F1 12 Tf 72 700 Td (Hello \\(one\\) \\101) Tj 0 -14 Td [(Se) 20 (cond) -300 (line)] TJ ET"),
        5: (b"<< /Type /Font /Subtype /Type1 >>", None),
        6: (b"", b"BT /F2 9 Tf <00410042004400500051> Tj T* (AB) Tj ET"),
        7: (b"<< /Type /Font /Subtype /Type0 /ToUnicode 8 0 R >>", None),
        8: (b"", cmap),
        9: (b"<< /CreationDate (D:20230102030405Z) /ModDate (D:20240506) >>", None),
        11: (f"/Type /ObjStm /N 2 /First {offset}".encode(), packed),
    }
    data = _pdf(objects, (4, 6, 11))
    assert pdf.pages(data) == ["Hello (one) A\nSecond line\n", "ébdxy\n"]
    assert pdf.stamp(data) == "D:20240506"
    assert [(t, m) for t, m in chunking.pdf_pages(data, "x.pdf")] == [("Hello (one) A\nSecond line", {"page": "1"}), ("ébdxy", {"page": "2"})]
    for bad in (b"", b"text", b"%PDF-1.4\n", data.replace(b"/Info", b"/Encrypt 12 0 R /Info")):
        if bad.startswith(b"%PDF-1.4"):
            assert pdf.pages(bad) == []
        else:
            with pytest.raises(ValueError):
                pdf.pages(bad)
    docs = spark.createDataFrame([("f", "n", "a.pdf", bytearray(data), "1"), ("f", "n", "b.md", bytearray(b"## H\ntext"), "2")], "source_type string, source_name string, source_path string, raw_content binary, checksum string")
    assert sorted((r["source_path"], r["idx"], r["raw_content"]) for r in chunking.to_fragments(docs).collect()) == [("a.pdf", 0, "Hello (one) A\nSecond line"), ("a.pdf", 1, "ébdxy"), ("b.md", 0, "## H\n\ntext")]


def test_clients():
    from corpusloom.functions import clients

    seen = []

    def post(lines, status=200):
        def send(url, headers, body):
            seen.append((url, headers, json.loads(body)))
            return status, lines

        return send

    events = [b"event: x", b'data: {"type": "content_block_delta", "delta": {"text": "a "}}', b"", b'data: {"type": "content_block_delta", "delta": {"text": "b"}}', b'data: {"type": "message_stop"}']
    assert clients.Messages("https://h/", "m", "k", post=post(events))("hi") == "a b"
    assert seen[-1][0] == "https://h/v1/messages" and seen[-1][1]["x-api-key"] == "k" and "system" not in seen[-1][2]
    lines = [b'data: {"choices": [{"delta": {"content": "x"}}]}', b'data: {"choices": [{"delta": {}}]}', b"data: [DONE]"]
    assert [*clients.Completions("https://h", "m", "k", post=post(lines)).stream("sys", [{"role": "user", "content": "q"}])] == ["x"]
    assert seen[-1][2]["messages"][0] == {"role": "system", "content": "sys"} and seen[-1][1] == {"Authorization": "Bearer k"}
    assert clients.Local("http://l", "m", post=post([b'{"message": {"content": "y"}}', b'{"done": true}']))("q") == "y"
    with pytest.raises(RuntimeError):
        clients.Local("http://l", "m", post=post([b"no"], 500))("q")
