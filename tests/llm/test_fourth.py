"""Targets of every window, samples by id and text, long and equal pages."""

import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import html_extract, langid, packing

# Packing


def mixture(shares, windows, length, least):
    """Ids of each source in each window, by partitions."""
    total, out = int(shares.totals.sum()), {}
    for p in range(-(-total // (windows * length))):
        end = min((p + 1) * windows * length, total)
        for i, (q, w, _) in packing.rounds(p, shares, windows, length, least).items():
            for a, b, x in zip(q, np.append(q[1:], shares.of(i, end)), w, strict=True):
                out.setdefault(int(x), {}).setdefault(i, 0)
                out[int(x)][i] += int(b - a)
    return out


@pytest.mark.parametrize("windows", (256, 4))
def test_every_window_meets_the_targets(windows):
    totals, weights = np.array([360_000, 41_000]), np.array([1.0, 1.0])
    got, left = mixture(packing.Shares(totals, weights), windows, 2048, 256), 41_000
    assert len(got) == -(-int(totals.sum()) // 2048)
    for w in sorted(got):
        n = got[w].get(1, 0)
        assert abs(n - 1024) <= 256 or left < 1024 + 256
        left -= n
    assert left == 0
    three = np.array([50_000, 30_000, 200_000])
    got = mixture(packing.Shares(three, np.array([3.0, 1.0, 0.0])), windows, 2048, 256)
    before_second = [got[w] for w in range(int(50_000 * 4 / 3) // 2048 - 1)]
    assert all(abs(x.get(0, 0) - 1536) <= 256 and abs(x.get(1, 0) - 512) <= 256 and 2 not in x for x in before_second)


def test_many_sources_are_few_numbers():
    rng = np.random.default_rng(0)
    totals = rng.integers(1, 4_000_000, 20_000)
    tracemalloc.start()
    try:
        shares, began = packing.Shares(totals, rng.random(20_000)), time.perf_counter()
        pieces = packing.rounds(3, shares, 256, 2048, 256)
        assert shares.holding(5, 0, 256 * 2048) == 0
        assert tracemalloc.get_traced_memory()[1] < 200 << 20 and time.perf_counter() - began < 60
    finally:
        tracemalloc.stop()
    assert len(pieces) > 10_000


def direct(queues, weights, length, least):
    """The rounds of one partition, source by source and id by id: (source, place in its queue) of every id of every window."""
    n, total = len(queues), sum(queues)
    shares = packing.Shares(np.array(queues), np.array(weights, float))
    at, deficit, out = [0] * n, [0.0] * n, []
    before = [0.0] * n
    for w, low in enumerate(range(0, total, length)):
        window, room = [], min(length, total - low)
        now = shares.exact(low + room).tolist()
        for i in range(n):
            deficit[i] += now[i] - before[i]
        before = now
        for i in [(w + j) % n for j in range(n)]:
            k = min(room - len(window), queues[i] - at[i], int(deficit[i]))
            if k >= min(least, length):
                window += [(i, at[i] + x) for x in range(k)]
                at[i], deficit[i] = at[i] + k, deficit[i] - k
        while len(window) < room:
            i = max((i for i in range(n) if at[i] < queues[i]), key=lambda i: deficit[i])
            k = min(room - len(window), queues[i] - at[i], max(least, int(deficit[i])))
            window += [(i, at[i] + x) for x in range(k)]
            at[i], deficit[i] = at[i] + k, deficit[i] - k
        out.append(window)
    return out


@pytest.mark.parametrize("targets", (None, {"a": 1, "b": 1, "c": 2}, {"b": 5, "d": 1}, {"a": 0.5}))
def test_placement_is_that_of_direct_rounds(spark, targets):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 300))), rng.choice(["a", "a", "a", "b", "c", "d"])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = packing.pack(df, length=128, least=32, targets=targets).collect()
    size = {r["doc_id"]: r["doc_tokens"] for r in out}
    names = sorted({r[2] for r in rows})
    first, queues = {}, [0] * len(names)
    for i, _, s in sorted(rows):
        first[i] = queues[names.index(s)]
        queues[names.index(s)] += size[i]
    wanted = direct(queues, [float(queues[k]) if targets is None else float(targets.get(s, 0)) for k, s in enumerate(names)], 128, 32)
    got = [{} for _ in wanted]
    for r in out:
        for x in range(r["length"]):
            got[r["sequence_id"]][r["offset"] + x] = (names.index(r["source"]), first[r["doc_id"]] + r["start"] + x)
    assert [[w[k] for k in range(len(w))] for w in got] == wanted


# Language


def _words(rng, of, n):
    return " ".join("".join(rng.choice(of) for _ in range(3)) for _ in range(n))


@pytest.mark.parametrize("ids", ("null", "one", "many"))
def test_languages_of_null_and_repeated_ids_are_learnt(spark, ids):
    rng = random.Random(6)
    rows = [({"null": None, "one": 5, "many": i}[ids], _words(rng, ["th", "er", "on"], 12), "en") for i in range(6000)]
    rows += [({"null": None, "one": 7, "many": 9000 + i}[ids], _words(rng, ["ch", "ei", "ü"], 12), "fr") for i in range(100)]
    rows += [(1, "the very same text", "xx")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.fit(df)
    assert model.languages == ["en", "fr", "xx"]
    taken = langid.sampled(df, doc_id="doc_id", text="text", lang="lang", sample=600).groupBy("lang").agg(F.count("*").alias("n")).collect()
    assert {r["lang"]: r["n"] for r in taken} == {"en": 600, "fr": 100, "xx": 1}
    out = langid.annotate(df.limit(6100), model).select("row.lang", "lang_pred").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.99


# Pages


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 350_000, "<span>" * 150_000 + "</b>" * 150_000, "<span>" * 100_000 + "<p></p>" * 100_000, "<a " + "a" * 1_000_000 + ">", '<a "' * 250_001 + ">", "<! " * 300_000,
        "<script>" + "</script " * 100_000 + "x", "<a '\"" * 200_000 + ">", "<" * 1_000_000, "<a" * 300_000 + ' "x>', "<a " * 300_000 + '">', "<a class='" + "ad_" * 200_000 + "!'>",
    ],
    ids=range(12),
)
def test_long_odd_pages_end(page):
    began = time.perf_counter()
    html_extract.blocks(page)
    assert time.perf_counter() - began < 5


def test_tags_that_are_not_ended():
    blocks = html_extract.blocks
    assert blocks("<p>one<a two</p>three") == [("open", "onethree")]  # ended by the next >
    assert blocks("x<b c='d>e") == [("open", "x<b c='d>e")]
    assert blocks("x<b c='d>e<i>f</i> <u g=\"'\">h") == [("open", "x<b c='d>ef h")]
    assert blocks("<div title=\"a>b\">x</div>y<") == [("open", "x"), ("open", "y<")]


def site(own):
    return f"<body><div>Site</div><div>{own}</div><div>Contact</div></body>"


def test_equal_pages_get_equal_texts(spark):
    rows = [(k, "http://h.org/a", site("x")) for k in (1, 2, 3)] + [(4, "http://h.org/b", site("y"))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "x", 2: "x", 3: "x", 4: "y"}


def test_copies_are_looked_past_across_ranges(spark):
    """Many copies, at one address and at many, over any number of ranges: every page is differenced with a page that is another one."""
    rows = [(k, "http://h.org/m", site("copy")) for k in range(40)] + [(100 + k, f"http://h.org/m/{k:02d}", site("mirror")) for k in range(40)]
    rows += [(200, "http://h.org/a", site("first")), (201, "http://h.org/z", site("last")), (300, "http://i.org/", site("alone")), (301, "http://i.org/", site("alone")), (None, "http://h.org/m", site("copy"))]
    want = {i: h.split("<div>")[2][:-6] if "h.org" in u else "Site\nalone\nContact" for i, u, h in rows}
    try:
        for parts in (1, 6, 50):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            got = [(r["page_id"], r["text"]) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()]
            assert len(got) == len(rows) and dict(got) == want, parts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")

