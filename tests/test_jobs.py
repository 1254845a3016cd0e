"""The jobs: brute force, growing input, runs that were cut off, command lines, and the registered queries against SQL."""

import glob
import hashlib
import json
import os
import random
import subprocess
import sys

import pytest

from jobs import queries, rate_sources, refresh_fragments
from test_catalog import rows_of

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CONFIG = {"passage_words": 5, "overlap_words": 2, "files_per_batch": 1000}
SCHEMA = "doc_id long, text string, source string, extra string, key string, batch long"


def passages(text):
    words, out = [w for w in "".join(" " if c in " \t\n\x0b\f\r" else c for c in text or "").split(" ") if w], []
    for start in range(0, len(words), 3):
        if start and start + 2 >= len(words):
            break
        out.append(" ".join(words[start : start + 5]))
    return out


def wanted(rows):
    """Passages of documents {key: (doc_id, source, text)}."""
    out = []
    for key, (doc_id, source, text) in rows.items():
        for k, content in enumerate(passages(text)):
            fragment = hashlib.sha256(f"documents:{source or ''}/{key}:{k}".encode()).hexdigest()[:16]
            out.append((doc_id, source, k, fragment, content, len(content.split(" ")), hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, path):
    names = ("doc_id", "source", "passage_no", "fragment_id", "content", "n_tokens", "checksum")
    return sorted((tuple(r[c] for c in names) for r in refresh_fragments.current(spark, path).collect()), key=repr)


def put(spark, rows, path, n=1):
    spark.createDataFrame([(*r, "x", "y", 7) for r in rows], SCHEMA).repartition(n).write.mode("append").parquet(path)


def text(rnd, n):
    return "".join(rnd.choice(["ab", "c", "dé.", "漢"]) + rnd.choice([" ", "\n", "\t ", " ", "  "]) for _ in range(n))


def test_growing_documents(spark, tmp_path):
    rnd, at = random.Random(1), str(tmp_path)
    go = lambda: refresh_fragments.run(spark, f"{at}/in", f"{at}/out", f"{at}/mark", CONFIG)
    first = [(k, text(rnd, rnd.randrange(12)), rnd.choice(["a", "b", "", None, "odd/name=1"])) for k in range(60)] + [(None, "no id at all", "a"), (100, None, "a"), (101, "", None), (102, "one", "b"), (102, "one", "b")]
    put(spark, first, f"{at}/in", 3)
    go()
    key = lambda r: str(r[0]) if r[0] is not None else "sha256:" + hashlib.sha256(r[1].encode()).hexdigest()
    state = {key(r): r for r in first}
    rows = lambda: {k: (d, s, t) for k, (d, t, s) in state.items()}
    assert found(spark, f"{at}/out") == wanted(rows())
    files = set(glob.glob(f"{at}/out/**/*.parquet", recursive=True))
    go()  # nothing is new
    assert found(spark, f"{at}/out") == wanted(rows()) and set(glob.glob(f"{at}/out/**/*.parquet", recursive=True)) == files
    # new, changed, emptied, moved back to what it was, and unchanged documents
    second = [(200, "quite new text here for you now", "c"), (3, "changed for good", "b"), (4, None, "a"), first[5], first[6], (7, "for a while", "a")]
    put(spark, second, f"{at}/in")
    go()
    state |= {key(r): r for r in second}
    assert found(spark, f"{at}/out") == wanted(rows())
    assert files < set(glob.glob(f"{at}/out/**/*.parquet", recursive=True))
    stored = refresh_fragments.stored(spark, f"{at}/out")
    assert sorted(r["key"] for r in stored.where("batch = 1").collect()) == sorted({"200", "3", "7"} | ({"4"} if first[4][1] else set()))
    put(spark, [first[7]], f"{at}/in")
    go()
    state[key(first[7])] = first[7]
    assert found(spark, f"{at}/out") == wanted(rows())


def test_a_batch_that_was_cut_off(spark, tmp_path, monkeypatch):
    """The batch fails after it was written in part and as a whole; the next run gives what one good run gives."""
    at, rows = str(tmp_path), [(k, f"some words of {k} and some more", "a" if k % 3 else "b") for k in range(20)]
    go = lambda: refresh_fragments.run(spark, f"{at}/in", f"{at}/out", f"{at}/mark", CONFIG)
    put(spark, rows[:10], f"{at}/in")
    go()
    put(spark, rows[8:], f"{at}/in")
    before = refresh_fragments.take

    def fails(batch, number, output, config):
        before(batch.where("doc_id % 2 = 0"), number, output, config)
        raise RuntimeError("stopped here")

    monkeypatch.setattr(refresh_fragments, "take", fails)
    with pytest.raises(Exception, match="stopped here"):
        go()
    monkeypatch.setattr(refresh_fragments, "take", before)
    go()
    assert found(spark, f"{at}/out") == wanted({str(k): (k, s, t) for k, t, s in rows})
    assert refresh_fragments.stored(spark, f"{at}/out").count() == 20


def test_no_documents(spark, tmp_path):
    put(spark, [], f"{tmp_path}/in")
    refresh_fragments.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark", CONFIG)
    assert found(spark, f"{tmp_path}/out") == []
    put(spark, [(1, "a b", "s")], f"{tmp_path}/in")
    refresh_fragments.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark", CONFIG)
    assert found(spark, f"{tmp_path}/out") == wanted({"1": (1, "s", "a b")})
    with pytest.raises(ValueError):
        refresh_fragments.windows(None, 5, 5)


RATE = {"least_chars": 4, "as_of": "2024-02-01 00:00:00", "salts": 3}


def test_rates_against_brute_force(spark, tmp_path):
    rnd, at = random.Random(2), str(tmp_path)
    rows = [
        (rnd.choice([None, *range(30)]), rnd.choice([None, "", "\n".join(rnd.choice(["same line", " same line\t", "abc", "other line", f"own {k}", " pad "]) for _ in range(rnd.randrange(6)))]), rnd.choice(["a", "b", "c", None]))
        for k in range(120)
    ]
    rows += [(500, "the licence of all\n" * 50, s) for s in "abc"] + [rows[0]] * 3
    spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, source string, lang string").repartition(5).write.parquet(f"{at}/d")
    marks = [(k, k % 2, int(k % 7 == 0)) for k in range(0, 30, 3)] * 2
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{at}/l")
    for _ in range(2):
        rate_sources.run(spark, f"{at}/d", f"{at}/l", f"{at}/out", RATE)
    said = {(i, s, t): {x for x in (y.strip(" \t\n\x0b\f\r") for y in (t or "").split("\n")) if len(x) >= 4} for i, t, s in rows}
    of = {}
    for (_, s, _t), lines in said.items():
        for x in lines:
            of.setdefault(x, set()).add(s)
    agreed = {0: 0.0, 1: 0.3, 2: 0.6, 3: 0.8, 4: 0.8}
    want = set()
    for (i, s, t), lines in said.items():
        mean = int(sum(len(of[x]) for x in lines) / len(lines) + 0.5) if lines else 0
        mark = 0.0 if i is None or i % 3 or i >= 30 else 0.1 * (i % 2) - 0.2 * (i % 7 == 0)
        want.add((i, s, None if t is None else hashlib.sha256(t.encode()).hexdigest(), len(lines), sum(len(of[x]) > 1 for x in lines), mean, agreed[mean], round(0.5 + mark, 2)))
    got = rate_sources.read_back(spark, f"{at}/out").collect()
    assert len(got) == len(want)
    assert {(r["doc_id"], r["source"], r["checksum"], r["n_statements"], r["n_shared"], r["n_sources"], r["corroboration"], r["consistency"]) for r in got} == want
    for r in got:
        its = [x for x in got if x["source"] == r["source"]]
        assert (r["source_documents"], r["source_statements"]) == (len(its), sum(x["n_statements"] for x in its))
        assert r["source_trust"] == pytest.approx(sum(x["overall"] for x in its) / len(its), abs=1e-4)
    # a source that is gone leaves nothing, and no rows at all are no failure
    spark.read.parquet(f"{at}/d").where("source = 'a'").write.parquet(f"{at}/d2")
    rate_sources.run(spark, f"{at}/d2", f"{at}/l", f"{at}/out", RATE)
    assert {r["source"] for r in rate_sources.read_back(spark, f"{at}/out").collect()} == {"a"}
    spark.read.parquet(f"{at}/d").limit(0).write.parquet(f"{at}/d3")
    rate_sources.run(spark, f"{at}/d3", f"{at}/l", f"{at}/out", RATE)
    assert rate_sources.read_back(spark, f"{at}/out").count() == 0


def test_command_lines(spark, tmp_path):
    at, env = str(tmp_path), os.environ | {"PYTHONPATH": ROOT}
    spark.createDataFrame([(1, "a b c d e f g h", "s", "en"), (2, "a longer line of text here", "t", "en")], "doc_id long, text string, source string, lang string").write.parquet(f"{at}/in")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels")
    with open(f"{at}/config.json", "w") as f:
        json.dump(CONFIG, f)
    base = [sys.executable, "-m"]
    said = [
        subprocess.run([*base, "jobs.refresh_fragments", "--documents", f"{at}/in", "--output", f"{at}/f", "--checkpoint", f"{at}/c", "--config", f"{at}/config.json"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300),
        subprocess.run([*base, "jobs.rate_sources", "--documents", f"{at}/in", "--labels", f"{at}/labels", "--output", f"{at}/r"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300),
    ]
    assert [x.returncode for x in said] == [0, 0], said
    assert "wrote 2 documents of 4 passages" in said[0].stderr and "wrote 2 documents and 2 sources" in said[1].stderr
    assert len(found(spark, f"{at}/f")) == 4 and rate_sources.read_back(spark, f"{at}/r").count() == 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)
