"""The pipeline against brute-force versions of its stages."""

import random
import re

import numpy as np

import corpus_pipeline
from corpusloom.llm import langid, packing

SYLLABLES = {"aa": ["th", "er", "on", "an", "re"], "bb": ["ch", "ei", "ü", "sch", "ge"]}


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def near(rows):
    sets = {}
    for r in rows:
        w = _words(r["text"])
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i, x in sets.items():
            for j, y in sets.items():
                if i < j and x and y and root[i] != root[j] and 100 * len(x & y) >= 80 * len(x | y):
                    a, b = sorted((root[i], root[j]))
                    root = {k: a if v == b else v for k, v in root.items()}
                    changed = True
    return [r for r in rows if root[r["doc_id"]] == r["doc_id"]]


def cut(rows, length=100):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        b = r["text"].encode()
        hit = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                hit[k : k + length] = b"\1" * length
            seen.add(b[k : k + length])
        kept, piece = "", b""
        for c, h in zip(b, hit):
            if h:
                kept, piece = kept + piece.decode(errors="ignore"), b""
            else:
                piece += bytes([c])
        kept += piece.decode(errors="ignore")
        if kept or not any(hit):
            out.append(r | {"text": kept, "n_chars": len(kept) if any(hit) else r["n_chars"]})
    return out


def leaks(rows, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    windows = set()
    for t in items:
        w = fold(t)
        n = min(10, len(w))
        windows |= {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if n else set()
    return [r for r in rows if not any(tuple(w[a : a + n]) in windows for w in [fold(r["text"])] for n in {len(x) for x in windows} for a in range(len(w) - n + 1))]


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    prose = lambda lang, n: " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    items = [prose("aa", 14), prose("bb", 4)]
    passage = prose("aa", 60)
    rows = []
    for i in rng.sample(range(5000), 150):
        lang = rng.choice(["aa", "bb"])
        kind = rng.randint(0, 7)
        text = prose(lang, rng.choice([5, 40, 120]))
        if kind == 0 and rows:
            w = (rng.choice(rows)["text"] or "x y").split(" ")
            w[rng.randrange(len(w))] = "q"
            text = " ".join(w)
        elif kind == 1:
            text += " " + passage + " " + prose(lang, 20)
        elif kind == 2 and rng.random() < 0.5:
            text += " " + rng.choice(items)
        rows.append({"doc_id": i, "text": text, "lang": lang, "source": rng.choice(["s", "s", "t", None]), "n_chars": len(text)})
    odd = [(9000, None), (9001, ""), (9002, "1 2 3 !"), (9003, passage)]
    rows += [{"doc_id": i, "text": t, "lang": "aa", "source": "s", "n_chars": len(t or "")} for i, t in odd]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = langid.fit(docs)
    out = {r["row"]["doc_id"]: r for r in langid.annotate(docs, model).collect()}
    want = [r for r in rows if re.search(r"[^\W\d_]", r["text"] or "") and out[r["doc_id"]]["score"] >= corpus_pipeline.LEAST_SCORE]
    assert len(want) >= 148
    wants = [want]
    for step in (near, cut, lambda r: leaks(r, items)):
        wants.append(step(wants[-1]))
    assert len({len(w) for w in wants}) == 4 or len(wants[1]) > len(wants[2]) > len(wants[3])

    for (name, stage), expected in zip(corpus_pipeline.STAGES[:4], wants, strict=True):
        result = stage(spark, docs, str(tmp_path))
        assert result.columns == list(corpus_pipeline.COLUMNS)
        result.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])
        assert got == sorted(expected, key=lambda r: r["doc_id"]), name
    key = lambda r: tuple(r)
    packed = sorted(map(key, packing.pack(spark.createDataFrame([tuple(r.values()) for r in wants[-1]], schema)).collect()), key=str)
    assert sorted(map(key, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == packed
    assert np.sum([r[3] for r in packed]) > 0


def test_repeated_rows_leave_one(spark, tmp_path):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, text, "aa", "s", 5), (1, text, "aa", "s", 5), (2, text, "aa", "s", 5), (None, "a b c d", "aa", None, 7), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.keep_one_of_each(spark, docs, "").collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "3", "None"]


def test_empty_stages(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_ids_repeat_and_lack(spark):
    """Rows, not ids, are kept or go."""
    rng = random.Random(8)
    a, b, c = (" ".join(rng.choice(SYLLABLES["aa"]) + str(rng.randrange(900)) for _ in range(60)) for _ in range(3))
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def left(rows):
        docs = spark.createDataFrame([(i, t, "aa", "s", k) for k, (i, t) in enumerate(rows)], schema).repartition(2)
        return sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()), key=str)

    assert left([(5, a), (5, b)]) == sorted([(5, a), (5, b)], key=str)
    assert left([(3, a), (5, a), (5, b)]) == sorted([(3, a), (5, b)], key=str)
    assert left([(None, a), (None, a), (7, a)]) == [(7, a)]
    assert left([(None, a), (None, a), (None, b), (2, c), (2, c)]) == sorted([(None, a), (None, b), (2, c)], key=str)
    near = a.split(" ")
    near[20] = "other"
    assert left([(5, a), (5, " ".join(near)), (6, b)])[-1] == (6, b)
    assert len(left([(5, a), (5, " ".join(near)), (6, b)])) == 2


def test_long_copies(spark):
    long = " ".join(f"w{k % 7919}" for k in range(120_000))
    docs = spark.createDataFrame([(i, t, "aa", "s", 1) for i, t in ((9, long), (4, long), (6, long + " more"), (7, "short text of its own words"))], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 7]
    assert corpus_pipeline.cut_repeats(spark, docs.where("doc_id in (4, 6)"), "").where("doc_id = 6").first()["n_chars"] < 200


def test_session_is_left_as_it_was(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the one", "aa", "s", 5, 9)], "doc_id long, text string, lang string, source string, n_chars long, root long")
    docs.withColumn("hash", docs["root"]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1
    assert spark.conf.get(key) == before
