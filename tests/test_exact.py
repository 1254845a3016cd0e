"""Selection by digits, suffixes as keys, digests of buckets, and distances to other digits, against brute force."""

import glob
import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.functions import text
from corpusloom.operators import digests, evaluate, fold, pivots, search, selection, storage, vector


def test_bits_have_the_order_of_numbers():
    values = np.array([0.0, -0.0, 1.5, -1.5, 1e308, -1e308, 5e-324, -5e-324, np.inf, -np.inf, 3.0, np.nan, -np.nan])
    bits = selection.ordered_bits(values)
    real = np.flatnonzero(~np.isnan(values))
    assert (np.argsort(bits[real], kind="stable") == np.argsort(values[real], kind="stable")).all() and bits[0] == bits[1]
    assert (bits[-2:] > bits[real].max()).all()
    back = selection.doubles(bits[real])
    assert (back == values[real]).all() and struct.pack("d", back[1]) == struct.pack("d", 0.0)


@pytest.mark.parametrize("bits", (16, 8))
def test_quantiles_against_sorting(spark, monkeypatch, bits):
    monkeypatch.setattr(selection, "BITS", bits)
    rnd = random.Random(bits)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(3), rnd.choice([None, 0.0, -0.0, 7.25, rnd.gauss(0, 1e6), -rnd.random(), float(rnd.randrange(5))])) for _ in range(400)] + [("one", 1, 3.5), ("none", 1, None)]
    rows += [("hot", 0, 1.0)] * 900 + [("hot", 0, float(k)) for k in range(101)]
    df = spark.createDataFrame(rows, "g string, h int, x double").repartition(5)
    got = {(r["g"], r["h"]): (r["n"], r["low"], r["mid"], r["p95"], r["least"]) for r in selection.quantiles(df, ["g", "h"], "x", cont={"low": 0.1, "mid": 0.5}, disc={"p95": 0.95, "least": 0.0}).collect()}
    want = {}
    for g, h, x in rows:
        if x is not None:
            want.setdefault((g, h), []).append(x)

    def between(v, q):
        at = (len(v) - 1) * q
        low, high = v[math.floor(at)], v[math.ceil(at)]
        return low + (high - low) * (at - math.floor(at))

    def nearest(v, q):
        return v[max(1, len(v) - math.floor(len(v) - q * len(v))) - 1]

    assert got == {k: (len(v), between(v, 0.1), between(v, 0.5), nearest(v, 0.95), v[0]) for k, v in ((k, sorted(v)) for k, v in want.items())}
    assert selection.quantiles(df.limit(0), ["g"], "x", disc={"m": 0.5}).count() == 0


def test_suffix_join_is_the_suffix_test(spark):
    rnd = random.Random(2)
    paths = ["".join(rnd.choice(["a", "b", "/", "\\", "c.md", "//"]) for _ in range(rnd.randrange(6))) for _ in range(150)] + ["", "/", None, "x/y/z.md", "x/y/z.md"]
    wanted = [(k, "".join(rnd.choice(["a", "b", "/", "c.md"]) for _ in range(rnd.randrange(4)))) for k in range(60)] + [(98, None), (99, "y/z.md"), (99, "z.md"), (99, "z.md")]
    p, e = spark.createDataFrame([(x, 1) for x in paths], "source_path string, q long"), spark.createDataFrame(wanted, "q long, expected string")
    joined = evaluate.found_in(p, e)
    got = sorted((r["q"], r["expected"], r["source_path"]) for r in joined.collect())
    holds = lambda a, b: a == b or a.endswith("/" + b) or a.endswith("\\" + b)
    assert got == sorted((q, b, a) for q, b in wanted if b is not None for a in paths if a is not None and holds(a, b))
    plan = joined._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_digests_find_what_a_join_finds(spark, tmp_path):
    rnd = random.Random(3)
    known = [(f"p{k}", str(rnd.randrange(3))) for k in range(300)] + [("twice", "1"), ("twice", "2")]
    seen = [(p, c if rnd.random() < 0.9 else "new") for p, c in known[:250]] + [(f"q{k}", "x") for k in range(20)] + [("twice", "2"), (None, "y")]
    df = lambda rows: spark.createDataFrame(rows, "source_path string, checksum string")
    told = lambda d: sorted(map(tuple, d.collect()), key=str)
    stored = digests.write(df(known), f"{tmp_path}/a")
    assert told(digests.changes(df(seen), stored)) == told(storage.changes(df(seen), df(known)))
    assert told(digests.changes(df(known[:301]), digests.stored(df([]), f"{tmp_path}/a"))) == told(storage.changes(df(known[:301]), df(known)))
    assert told(digests.changes(df([]), stored)) == sorted((p, "deleted") for p in {p for p, _ in known})
    assert told(digests.changes(df(seen), digests.write(df([]), f"{tmp_path}/b"))) == told(storage.changes(df(seen), df([])))


def test_few_changes_read_few_folders(spark, tmp_path):
    rows = [(f"d/{k}.md", str(k)) for k in range(5000)]
    df = lambda rows: spark.createDataFrame(rows, "source_path string, checksum string")
    stored = digests.write(df(rows), str(tmp_path))
    assert len(glob.glob(f"{tmp_path}/known/folder=*")) == digests.FOLDERS
    now = [(p, "other" if p == "d/77.md" else c) for p, c in rows if p != "d/123.md"]
    placed = digests._placed(df(now), "source_path", "checksum")
    folders, leaves = digests.differing(placed, stored)
    assert 1 <= len(folders) <= 2 and leaves.count() <= 2
    out = digests.changes(df(now), stored)
    assert sorted(map(tuple, out.where("state <> 'unchanged'").collect())) == [("d/123.md", "deleted"), ("d/77.md", "changed")] and out.count() == 5000
    assert "PartitionFilters: [" in out._jdf.queryExecution().toString() and "folder" in out._jdf.queryExecution().toString()
    assert digests.differing(digests._placed(df(rows), "source_path", "checksum"), stored)[0] == []


def test_neighbours_to_other_digits(spark):
    rng = np.random.default_rng(1)
    points = np.round(rng.normal(size=(80, 4)), 1)
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, points[i].tolist()) for i in range(5)], "query_id long, embedding array<double>")
    got = [tuple(r) for r in vector.knn(rows, asked, 7, digits=1).orderBy("query_id", "rank").collect()]
    want = []
    for q in range(5):
        d = np.round(np.sqrt(((points - points[q]) ** 2).sum(1)), 1)
        want += [(q, int(i), float(d[i]), k + 1) for k, i in enumerate(np.lexsort((np.arange(80), d))[:7])]
    assert [(q, i, k) for q, i, _, k in got] == [(q, i, k) for q, i, _, k in want]


@pytest.mark.parametrize("k,n_pivots", ((1, 1), (5, 8), (400, 8)))
def test_pivots_lose_no_neighbour(spark, tmp_path, k, n_pivots):
    rng = np.random.default_rng(k)
    points = np.concatenate([rng.normal(m, 0.3, (60, 3)) for m in (-5, 0, 4, 9)] + [np.repeat([[1.0, 1.0, 1.0]], 80, 0)])
    rows = [(int(i), p.tolist()) for i, p in enumerate(points)] + [(900, None), (901, [1.0]), (902, points[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = [(i, points[i].tolist()) for i in range(0, 300, 37)] + [(1000, [50.0, 0.0, 0.0]), (1001, None), (1002, [0.0])]
    asked = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    index, told = pivots.build(df, f"{tmp_path}/index", pivots=n_pivots), {}
    assert index.rows(spark).count() == len(points) + 1
    rows_of = lambda d: sorted(tuple(r[c] for c in ("query_id", "rank", "vec_id", "distance")) for r in d.collect())
    wanted = rows_of(vector.knn(df.where("size(embedding) = 3"), asked.where("size(embedding) = 3"), k))
    assert rows_of(pivots.knn(index, asked, k, told=told)) == wanted
    assert rows_of(pivots.knn(index, asked, k, block_bytes=48)) == wanted
    if k == 5:
        assert told["rows"] < 2 * len(points)
        near = {}
        pivots.knn(index, asked.where("query_id = 37"), k, told=near)
        assert near["rows"] < len(points) / 2
    empty = pivots.build(df.limit(0), f"{tmp_path}/none")
    assert pivots.knn(empty, asked, k).count() == 0 and pivots.knn(index, asked.limit(0), k).count() == 0


def test_ranking_beyond_what_is_sent(spark, monkeypatch):
    rnd = random.Random(5)
    docs = spark.createDataFrame([(k, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(30))) if k % 11 else None) for k in range(120)], "doc_id long, text string")
    asked = spark.createDataFrame([(k, " ".join(rnd.choice(["a", "b", "c-d", "e", "h-a", "zz"]) for _ in range(rnd.randrange(1, 4)))) for k in range(30)], "query_id long, query string")
    keep = docs["doc_id"] % 3 != 0
    rows = lambda: sorted(tuple(r) for r in search.bm25(docs, asked, 5, keep=keep).collect())
    sent = rows()
    monkeypatch.setattr(search, "SENT_TERMS", 0)
    assert sent and rows() == sent


def test_tasks_score_what_they_read(spark, monkeypatch):
    """Sent queries exchange no occurrences: of a table with different ids only the k best of each piece; small pieces, ties and shared ids change no row."""
    rnd = random.Random(8)
    rows = [(k, " ".join(rnd.choice("abcdef") for _ in range(rnd.randrange(25))) if k % 9 else None) for k in range(150)] + [(1000 + k, "a b c-d a") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(k, " ".join(rnd.choice(["a", "b", "c-d", "d-a-b", "a-a", "zz"]) for _ in range(rnd.randrange(4)))) for k in range(40)], "query_id int, query string")
    found = search.bm25(docs, asked, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = lambda df: sorted(tuple(r) for r in search.bm25(df, asked, 5).collect())
    twice = docs.unionByName(docs.where("doc_id % 4 = 0"))
    sent, shared, before = got(docs), got(twice), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sent and got(docs) == sent
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got(docs.limit(0)) == []
    monkeypatch.setattr(search, "SENT_TERMS", 0)
    assert got(docs) == sent and got(twice) == shared
    monkeypatch.setattr(search, "PIECE_TOKENS", 5)
    batch = pa.RecordBatch.from_arrays([pa.array([["a"] * n for n in (2, 3, 9, 0, 4, 1)])], ["t"])
    assert [sizes.tolist() for _, sizes in search._pieces(batch, 0)] == [[2, 3], [9], [0, 4, 1]]


def test_rows_that_share_an_id_take_no_others_along(spark, monkeypatch):
    """Of rows that share an id phrases are exchanged, and of no other row; one phrase is found in one row, and rows of one id count together, whatever their length or id."""
    rnd = random.Random(9)
    rows = [(k, " ".join(rnd.choice("abcdef") for _ in range(1 + rnd.randrange(12)))) for k in range(120)]
    rows += rows[:20:4] + [(4, "c"), (4, "x d"), (8, "a b"), (None, "a c d"), (None, "a c d"), (None, "b"), (200, "y c"), (200, "y d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = {0: ["a"], 1: ["c d"], 2: ["a", "b"], 3: ["c d", "a"], 4: ["y"], 5: ["zz", "a"], 6: ["d a b"]}
    held = {}  # by id and length, as in the SQL
    for i, t in rows:
        for p in {p for ps in asked.values() for p in ps}:
            if n := sum(t.split()[j : j + len(p.split())] == p.split() for j in range(len(t.split()))):
                held[i, len(t.split()), p] = held.get((i, len(t.split()), p), 0) + n
    df, mean = {p: sum(x[2] == p for x in held) for ps in asked.values() for p in ps}, sum(len(t.split()) for _, t in rows) / len(rows)
    want = []
    for q, ps in asked.items():
        for i in {i for i, _ in rows}:
            mine = [(dl, tf, df[p]) for (d, dl, p), tf in held.items() if d == i and p in ps]
            if len(mine) == len(ps) == len({p for d, _, p in held if d == i and p in ps}):
                parts = [max(math.log((len(rows) - n + 0.5) / (n + 0.5)), 1e-6 if n * 2 >= len(rows) else 0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) for dl, tf, n in mine]
                want.append((q, i, pytest.approx(sum(parts), abs=2e-6)))
    sent = spark.createDataFrame([(q, " ".join(p.replace(" ", "-") for p in ps)) for q, ps in asked.items()], "query_id int, query string")
    kept, write = {}, search.written
    monkeypatch.setattr(search, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    by = lambda r: (r[0], r[1] is not None, r[1] or 0)
    got = lambda: sorted((tuple(r)[:3] for r in search.bm25(docs, sent, 500).collect()), key=by)
    assert got() == sorted(want, key=by)
    twice = {i for i, _ in rows if [j for j, _ in rows].count(i) > 1}
    assert {r["doc_id"] for r in kept["occurrences"].collect()} == twice & {x[0] for x in held}
    for limit in ("SENT_IDS", "SENT_TERMS"):
        monkeypatch.setattr(search, limit, 0)
        kept.clear()
        assert got() == sorted(want, key=by)


@pytest.mark.parametrize("parts", (1, 5, 30))
def test_fold_over_ranges(spark, parts):
    rnd = random.Random(parts)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", "b", None]), rnd.choice([None, *range(200)]), rnd.choice(["x", "é" * rnd.randrange(20), None, ""])) for _ in range(700)] + [("big", 1, "y" * 5000)] + [("same", 1, "z")] * 40
    df = spark.createDataFrame(rows, "k string, o long, t string").repartition(4)
    got = {}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        for r in fold.documents(df, "k", ["o"], df["t"], 100, parts=parts).collect():
            assert (r["k"], r["part"]) not in got and len(r["content"].encode()) < 100 + 5000
            got[r["k"], r["part"]] = (r["content"], r["n"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = {}
    for k in {r[0] for r in rows}:
        at = 0
        for _, line in sorted(((o is not None, o or 0), t or "") for key, o, t in rows if key == k):
            text, n = want.get((k, at // 100), ("", 0))
            want[k, at // 100] = (text + line, n + 1)
            at += len(line.encode())
    assert got == want
    assert fold.documents(df.limit(0), "k", ["o"], df["t"], 100).count() == 0


def test_vectors_as_exact_decimals(spark):
    """Of two equally near decimals the even one, as printf has it; the sign of what rounds to 0 stays."""
    values = [k / 128 for k in range(-300, 300)] + [-0.0, -1e-9, 1e-9, 1e6, 123.4567895, *np.random.default_rng(1).normal(0, 0.1, 200).astype(np.float32).tolist()]
    df = spark.createDataFrame([(0, values), (1, [0.5, None]), (2, []), (3, None)], "i int, v array<float>")
    got = {r[0]: r[1] for r in df.select("i", storage.tsv_line(df["v"])).collect()}
    assert got == {0: "\t".join(f"{float(np.float32(v)):.6f}" for v in values), 1: "0.500000", 2: "", 3: None}


def test_sizes_as_exact_decimals(spark):
    values = [0, 1023, 1024, 1280, 5376, 1048575, *(1024 * k + 256 for k in range(1, 60)), *(1048576 * k + 262144 * j for k in range(1, 9) for j in (1, 3)), None]
    df = spark.createDataFrame([(v,) for v in values], "n long")
    want = [None if n is None else f"{n / 1048576:.1f} MB" if n >= 1048576 else f"{n / 1024:.1f} KB" if n >= 1024 else f"{n} B" for n in values]
    assert [r[0] for r in df.select(text.size(df["n"])).collect()] == want
