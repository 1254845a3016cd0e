"""Vectors, full text, fusion, trust and answers against plain versions."""

import itertools
import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import catalog
from corpusloom.functions import models, trust
from corpusloom.functions import text as X
from corpusloom.operators import fusion, search, vector
from corpusloom.plans import query as plans
from corpusloom.plans.cache import MemoryCache
from corpusloom.schema import fragments


def test_knn(spark):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(300, 8)).astype(np.float32)
    points[10] = points[20]
    rows = [(i, v.tolist()) for i, v in enumerate(points)] + [(900, None), (901, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    queries = df.where("vec_id % 40 = 10").withColumnRenamed("vec_id", "query_id")
    for block in (1 << 20, 100):
        got = {}
        for r in vector.knn(df, queries, 4, block_bytes=block).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["distance"]))
        for q, found in got.items():
            d = np.round(np.linalg.norm(points.astype(float) - points[q].astype(float), axis=1), 6)
            want = sorted((x, i) for i, x in enumerate(d))[:4]
            assert [(round(x[2], 6), x[1]) for x in sorted(found)] == [(round(x, 6), i) for x, i in want]
    assert vector.knn(df.limit(0), queries, 4).count() == 0


def test_unit_axes(spark):
    df = spark.createDataFrame([(i, [1.0 if j == i else 0.0 for j in range(4)]) for i in range(4)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [0.9, 0.1, 0.0, 0.0])], "query_id long, embedding array<float>")
    assert [r["vec_id"] for r in vector.knn(df, q, 2).orderBy("rank").collect()] == [0, 1]


def test_blend(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "a array<float>, b array<float>")
    out = df.select(vector.blend(F.col("a"), F.col("b"), 0.3), vector.normalise(F.array(F.lit(3.0), F.lit(4.0))), vector.squared_l2(F.col("a"), F.col("b"))).first()
    n = math.sqrt(1.09)
    assert np.allclose(out[0], [1 / n, 0.3 / n]) and np.allclose(out[1], [0.6, 0.8]) and out[2] == 2


def test_bm25_is_sqlites(spark):
    """Scores of the built-in engine of SQLite, which ranks by the same formula."""
    rng = random.Random(6)
    words = ["fox", "dog", "docker", "compose", "kube", "the", "a1", "run"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(80)] + [(100, "docker-compose up"), (101, ""), (102, None)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(content, tokenize = 'unicode61')")
    con.executemany("INSERT INTO t(rowid, content) VALUES (?, ?)", [(i, t or "") for i, t in docs])
    queries = [(1, "fox"), (2, "fox dog"), (3, "docker-compose"), (4, 'the "run" kube'), (5, "nothing"), (6, "? fox"), (7, "")]
    got = {}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for r in search.bm25(df, spark.createDataFrame(queries, "query_id long, query string"), 100).collect():
        got.setdefault(r["query_id"], {})[r["doc_id"]] = r["score"]
    for q, text in queries:
        phrases = " ".join(f'"{w}"' for w in text.replace('"', "").split())
        want = dict(con.execute("SELECT rowid, -rank FROM t WHERE t MATCH ?", (phrases,)).fetchall()) if phrases else {}
        assert set(got.get(q, {})) == set(want), text
        assert all(abs(got[q][i] - s) < 2e-6 for i, s in want.items()), text


def test_rrf(spark):
    lists = {0: "abc", 1: "cab", 2: "bd"}
    rows = [(0, x, k, r) for k, items in lists.items() for r, x in enumerate(items, 1)]
    df = spark.createDataFrame(rows, "query_id long, doc_id string, list_id int, rank long")
    score = {}
    for _, x, _, r in rows:
        score[x] = score.get(x, 0) + 1 / (60 + r)
    want = sorted(score, key=lambda x: (-round(score[x], 12), x))
    for order in itertools.islice(itertools.permutations(rows), 0, 40320, 9000):
        out = fusion.fuse(spark.createDataFrame(list(order), df.schema)).orderBy("rank").collect()
        assert [r["doc_id"] for r in out] == want
    one = df.where("list_id = 0")
    assert [r["doc_id"] for r in fusion.fuse(one, 2).orderBy("rank").collect()] == ["a", "b"]
    assert fusion.fuse(df.limit(0)).count() == 0
    firsts = fusion.distinct_in_order(df, 3).orderBy("rank").collect()
    assert [r["doc_id"] for r in firsts] == ["a", "b", "c"]


@pytest.mark.parametrize("kind,days,want", [(".go", 900, 0.95), (".md", 0, 1.0), (".md", -3, 1.0), (".md", 130, 0.37), (".md", 5000, 0.1), (".md", None, 0.3), (".JSON", 10, 0.95)])
def test_freshness(spark, kind, days, want):
    date = "cast(null as timestamp)" if days is None else f"timestamp'2024-02-01 00:00:00' - make_dt_interval({days})"
    row = spark.sql(f"SELECT {date} AS d, '{kind}' AS k").select(trust.freshness(F.col("d"), F.lit(None).cast("timestamp"), F.col("k"))).first()
    assert row[0] == want


def test_trust_values(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert [get(trust.corroboration(F.lit(n))) for n in (0, 1, 2, 3, 4, 5, 9)] == [0, 0.3, 0.6, 0.8, 0.8, 1, 1]
    assert [get(trust.consistency(F.lit(a))) for a in (0.0, 0.2, -0.9, 0.9)] == [0.5, 0.7, 0, 1]
    assert [get(trust.authority(F.lit(k))) for k in (".md", "md", ".py", "x.YAML", ".txt", ".html", ".bin", "")] == [0.8, 0.8, 0.7, 0.65, 0.6, 0.55, 0.5, 0.5]
    assert get(trust.overall(*map(F.lit, (0.94, 0.85, 1.0, 0.95)))) == 0.94
    assert get(trust.round2(F.lit(1.005))) == 1.0


def test_citations_and_text(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(X.citations(F.lit("x [abcdef12] y [abcdef12] [0123456789abcdef] [abc]"))) == ["abcdef12", "0123456789abcdef"]
    assert get(X.citations(F.lit("none"))) == []
    assert get(X.strip_meta(F.lit(f"a {X.META} b {X.META} c"))) == f"a {X.META} b"
    assert get(X.expansions(F.lit("1. one\n2) two\n- three\n* four\n\n-x\nsix\nseven"))) == ["one", "two", "three", "four", "-x"]  # a mark alone with one letter is text
    assert [get(X.age(F.lit(d))) for d in (0, 1, 29, 30, 364, 365, 800)] == ["today", "1 day", "29 days", "1 month", "1 year", "1 year", "2 years"]
    assert [get(X.size(F.lit(n))) for n in (5, 2048, 3 << 20)] == ["5 B", "2.0 KB", "3.0 MB"]
    paths = lambda *p: F.array(*map(F.lit, p))
    assert get(X.common_directory(paths("a/b/c.md", "a/b/d/e.md"))) == "a/b"
    assert get(X.common_directory(paths("a/x.md", "b/y.md"))) == "" and get(X.common_directory(paths("x.md"))) == ""
    assert get(X.mask(F.lit("secret-token"))) == "secret-t****" and get(X.split_csv(F.lit(" a,,b "))) == ["a", "b"]


def test_cited_fragments(spark):
    rows = spark.createDataFrame([(1, "aaaaaaaa", 1), (1, "bbbbbbbb", 2), (2, "cccccccc", 1)], "query_id long, id string, rank long")
    said = spark.createDataFrame([(1, "see [bbbbbbbb] and [ffffffff]"), (2, "nothing")], "query_id long, answer string")
    out = sorted((r["query_id"], r["pos"], r["id"]) for r in plans.cited(said, rows).collect())
    assert out == [(1, 0, "bbbbbbbb"), (2, 0, "cccccccc")]


def test_embedder_and_context(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "b", None, "c", "d"])], "d long, i long, t string")
    out = df.select("i", models.embed(F.col("t"), models.HashEmbedder(8)).alias("v")).collect()
    assert all(abs(np.linalg.norm(r["v"]) - 1) < 1e-6 for r in out if r["i"] != 2) and [r for r in out if r["i"] == 2][0]["v"] is None
    last = models.context(df, ["d"], "i", "t").where("i = 3").first()
    assert (last["previous"], last["following"]) == ("a\n\nb", "d")


def test_memory_cache():
    c = MemoryCache(most=2)
    c.put("a", "s", "A", 0)
    assert c.get("a", 100) == "A" and c.get("a", 130) is None and c.get("a", 130, "s") == "A" and c.get("a", 130, "t") is None
    assert c.get("a", 601, "s") is None and c.get("a", 0) is None
    for k in "bcd":
        c.put(k, "s", k, 0)
    assert c.get("b", 1) is None and c.get("d", 1) == "d"


def _corpus(spark, tmp_path, n=3000):
    """documents, labels, benchmark and embeddings of such sizes that only what is found is small enough to be sent."""
    at = str(tmp_path)
    texts = F.concat_ws(" ", F.lit("fox"), F.sha2(F.col("id").cast("string"), 256), F.sha2((F.col("id") + 7).cast("string"), 256))
    ids = spark.range(n)
    ids.select(F.col("id").alias("doc_id"), texts.alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), (F.col("id") % 4).cast("string")).alias("source")).write.parquet(f"{at}/documents.parquet")
    ids.where("id % 3 > 0").select(F.col("id").alias("doc_id"), (F.col("id") % 5).cast("double").alias("quality"), (F.col("id") % 2).cast("double").alias("toxic")).write.parquet(f"{at}/labels.parquet")
    ids.select(F.col("id").alias("vec_id"), F.array(*(F.rand(k).cast("float") for k in range(8))).alias("embedding")).write.parquet(f"{at}/embeddings.parquet")
    spark.range(6).select((F.col("id") * 11).alias("item_id"), F.lit("fox").alias("text")).coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture
def large(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    yield _corpus(spark, tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_results_take_no_other_texts_along(spark, large):
    """Results are small, and are sent to the fragments: no texts are exchanged or hashed but theirs, and checksums are not read in a second pass."""
    plan = _plan(catalog.QUERIES["result_signature"](spark, large))
    assert "SortMergeJoin" not in plan and plan.count("text:string") == 1
    assert plan.index("sha2") < plan.index("LeftSemi")
    rows = catalog._trusted(spark, large, "checksum")
    plan = _plan(rows.select("query_id", "raw_content"))
    assert "SortMergeJoin" not in plan and "LeftSemi" in plan
    got = {r["doc_id"]: (r["id"], r["checksum"], r["confidence_adj"], r["raw_content"]) for r in rows.collect()}
    want = {r["doc_id"]: (r["id"], r["checksum"], r["confidence_adj"], r["raw_content"]) for r in fragments(spark, large).collect()}
    assert len(got) >= 20 and all(want[k] == v for k, v in got.items())


def test_hints_take_no_other_texts_along(spark, large):
    docs = spark.read.parquet(f"{large}/documents.parquet").select("doc_id", F.col("source").alias("source_path"), F.col("text").alias("raw_content"))
    lists = spark.createDataFrame([(1, 5, 0, 1), (1, 9, 0, 2), (1, 5, 1, 1), (2, 7, 1, 1)], "query_id long, doc_id long, list_id int, rank long")
    out = plans.scouted(docs, lists)
    assert "SortMergeJoin" not in _plan(out) and "Exchange hashpartitioning(doc_id" not in _plan(out)
    assert sorted((r["query_id"], r["rank"], r["hint"][:10]) for r in out.collect()) == [(1, 1, "[src1] fox"), (1, 2, "[src1] fox"), (2, 1, "[src3] fox")]


def test_questions_take_no_other_vectors_along(spark, large):
    """Of all embeddings only those of the questions are exchanged; a question without one is still asked."""
    vectors = spark.read.parquet(f"{large}/embeddings.parquet")
    asked = spark.read.parquet(f"{large}/benchmark.parquet").select(F.when(F.col("item_id") == 0, -1).otherwise(F.col("item_id")).alias("query_id"), "text")
    out = catalog._embedded(spark, large, asked)
    assert "LeftSemi" in _plan(out)
    held = {r["vec_id"]: r["embedding"] for r in vectors.collect()}
    assert sorted((r["query_id"], r["embedding"]) for r in out.collect()) == [(-1, None)] + [(k, held[k]) for k in (11, 22, 33, 44, 55)]
