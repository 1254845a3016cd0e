"""Language ID, media columns and HTML extraction."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import html_extract, langid, media
from corpusloom.llm.shared import utf8


def _prose(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


SYLLABLES = {"aa": ["th", "er", "on", "an", "re"], "bb": ["ch", "ei", "ü", "sch", "ge"], "cc": ["ó", "ci", "ado", "ña", "la"]}


def test_language(spark):
    rng = random.Random(5)
    rows = [(i, _prose(rng, SYLLABLES[k], rng.choice([3, 40, 300])), k) for i in range(240) for k in [rng.choice([*SYLLABLES])]]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !!", "cc"), (1003, "th er on", None), (1004, "Ω", "aa"), (1005, _prose(rng, SYLLABLES["bb"], 40_000), None), (None, "sch ge", "bb")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    out = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert len(out) == len(rows)
    right = [out[i]["lang_pred"] == k for i, _, k in rows[:240] if out[i]["held_out"]]
    assert len(right) > 30 and np.mean(right) > 0.97
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(240))
    assert [out[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1000]["score"] == 0
    assert out[1003]["lang_pred"] == "aa" and out[1005]["lang_pred"] == "bb" and out[1004]["lang_pred"] in SYLLABLES
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.identify(df.limit(0)).count() == 0
    blank = langid.identify(df.withColumn("lang", df["lang"].substr(9, 1)).where("doc_id is null").drop("lang").selectExpr("*", "cast(null as string) lang"))
    assert [(r["lang_pred"], r["score"]) for r in blank.collect()] == [("und", 0.0)]


def test_presence_kernel():
    texts = [b"The cat", b"", "é".encode(), b"abcabc" * 10]
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = langid.presence(raw, at)
    for i, t in enumerate(texts):
        alone = langid.presence(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert (alone[0] == whole[i]).all()
    assert whole[3].sum() == 9 and whole[1].sum() == 0  # abc: 3 of each length
    big = np.frombuffer(b"xyz " * 700_000, np.uint8)
    assert langid.presence(big, np.array([0, len(big)])).sum() == langid.presence(big[:20], np.array([0, 20])).sum()


def test_direct_ridge_solution(spark):
    """The weights' values are those of one solution over all examples, with kernels of sets."""
    rng = random.Random(11)
    rows = [(i, _prose(rng, SYLLABLES[k], rng.choice([2, 30, 90])), k) for i in range(60) for k in [rng.choice([*SYLLABLES])]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(df, landmarks=6)

    def grams(raw):
        t = bytes(langid._FOLD[np.frombuffer(raw, np.uint8)])
        one = {("1", t[k]) for k in range(len(t))}
        two = {("2", (int.from_bytes(t[k : k + 2], "big") * 0x9E3779B1 & 0xFFFFFFFF) >> 20) for k in range(len(t) - 1)}
        return one | two | {("3", (int.from_bytes(t[k : k + 3], "big") * 0x85EBCA6B & 0xFFFFFFFF) >> 18) for k in range(len(t) - 2)}

    at = np.concatenate([[0], np.cumsum(langid.TABLES)])
    marks = [{(str(1 + int(np.searchsorted(at, c, "right")) - 1), int(c - at[int(np.searchsorted(at, c, "right")) - 1])) for c in np.flatnonzero(z)} for z in model.landmarks]
    k = lambda x, y: len(x & y) / np.sqrt(len(x) * len(y)) if x and y else 0.0
    examples = [(grams(e), name) for _, t, name in rows for e in langid._examples(t)]
    languages = sorted(SYLLABLES)
    knm = np.array([[k(x, z) for z in marks] for x, _ in examples])
    kmm = np.array([[k(x, z) for z in marks] for x in marks])
    y = np.array([[1.0 if name == lang else -1.0 for lang in languages] for _, name in examples])
    w = np.array([len(examples) / len(languages) / sum(n == name for _, n in examples) for _, name in examples])[:, None]
    direct = np.linalg.solve(knm.T @ (w * knm) + langid.RIDGE * len(examples) * kmm + 1e-6 * np.eye(len(marks)), knm.T @ (w * y))
    assert model.languages == languages
    tests = [_prose(rng, SYLLABLES[name], 20).encode() for name in languages for _ in range(5)]
    mine = np.concatenate([model.values(m) for _, m in langid.batches(*langid._joined(tests))])
    assert np.allclose(mine, np.array([[k(grams(t), z) for z in marks] for t in tests]) @ direct, atol=2e-3)


def test_every_language_is_learnt(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, _prose(rng, [f"{chr(97 + i % 26)}{chr(97 + i % 23)}", f"q{chr(97 + i % 26)}"], 30), f"l{i % 40:02d}") for i in range(200)]
    rows += [(1000 + i, "123", "l00") for i in range(300)]
    monkeypatch.setattr(langid, "MOST_LANDMARKS", 12)
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=4)
    assert model.languages == [f"l{i:02d}" for i in range(40)] and len(model.landmarks) == 12


def _payload(text):
    data = (text or "").encode()
    return data + bytes(-len(data) % 64 or (0 if data else 64))


TEXTS = ["", None, "a", "`" * 200, "a`b" * 300, "x" * 64, "y" * 65, "é😀" * 100, "\x00" * 130, "`" * 40 + "z" + "`" * 100, "日本" * 9000, "ÿ" * 500, "a"]


def test_media_round_trip(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, width int")
    out = {r["doc_id"]: r for r in media.store(df).collect()}
    for i, t in enumerate(TEXTS):
        data, r = _payload(t), out[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(data[-64:])
    assert out[0]["media_sha256"] == out[1]["media_sha256"] and out[2]["thumb_hash"] == out[12]["thumb_hash"]
    assert media.store(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a", 1), (None, "a", 1), (7, None, 2)], "doc_id long, text string, media int")
    assert sorted((str(r["doc_id"]), r["n_bytes"]) for r in media.store(odd).collect()) == [("7", 0), ("None", 1), ("None", 1)]


def test_media_any_split():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    at = np.concatenate([[0], np.sort(rng.integers(0, 5000, 20)), [5000]])
    for picture, a, b in zip(media.encode(data, at), at[:-1], at[1:], strict=True):
        want = data[a:b].tobytes()
        want += bytes(-len(want) % 64 or (0 if want else 64))
        got = media.describe([picture])[0]
        assert got["payload_sha256"] == hashlib.sha256(want).hexdigest()
        thumb = media.decode_slowly(picture, media.Picture(picture))
        assert media.hashes(thumb.reshape(-1), np.zeros(1, np.int64), np.array([thumb.shape[1]]), np.array([thumb.shape[0]])) == [got["thumb_hash"]]


def _colour_jpeg(luma, interval):
    """A 4:2:0 picture of 32 x 16 samples whose eight luma blocks have the given DC values, other coefficients 0."""
    dc, ac = media.codes(*media.DC), media.codes(*media.AC)
    bits, out, before, n = "", b"", [0, 0, 0], 0

    def put(code):
        return format(code[0], f"0{code[1]}b")

    for mcu in range(2):
        for c, values in ((0, [luma[r][2 * mcu + k] for r in range(2) for k in range(2)]), (1, [5 * mcu]), (2, [-3])):
            for v in values:
                d = v - before[c]
                before[c] = v
                size = abs(d).bit_length()
                bits += put(dc[size]) + (format(d if d >= 0 else d + (1 << size) - 1, f"0{size}b") if size else "") + put(ac[0])
        if mcu == 1 or interval:
            bits += "1" * (-len(bits) % 8)
            out += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
            bits, before = "", [0, 0, 0]
            if mcu == 0:
                out += bytes([0xFF, 0xD0 + n])
                n += 1
    segment = media._segment
    return (
        b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, b"\x00" + b"\x08" * 64)
        + segment(0xC0, struct.pack(">BHHB", 8, 16, 32, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00")
        + segment(0xC4, b"\x00" + media.DC[0] + media.DC[1] + b"\x10" + media.AC[0] + media.AC[1])
        + (segment(0xDD, b"\x00\x01") if interval else b"") + segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + out + b"\xff\xd9"
    )


@pytest.mark.parametrize("interval", [False, True])
def test_media_colour(interval):
    luma = [[10, -20, 30, 0], [100, 90, -128, 7]]
    picture = _colour_jpeg(luma, interval)
    thumb = media.decode_slowly(picture, media.Picture(picture))
    assert (thumb == np.array(luma) + 128).all()
    got = media.describe([picture, None, b"no", picture[:-20]])
    assert (got[0]["width"], got[0]["height"]) == (32, 16) and got[0]["thumb_hash"]
    assert got[1]["media_bytes"] is None and got[2]["width"] is None and got[3]["width"] is None


def test_html_blocks():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class='no-sidebar'><nav><a>Home</a></nav><div class='cookie-notice'>We</div>"
        "<article><header><h1>Head&amp;line</h1></header><p>One <b>two\n three</b><br>four<p>five&nbsp;&lt;x&gt;<div class=\"ad\">buy</div>"
        "<script>var t='</p>';</script><aside>x</aside><section id='comments'><p>spam</section><form><p>Name</form><ul><li>a<li>b</ul>tail</article>"
        "<footer>f</footer></body></html>"
    )
    assert html_extract.main_text(html_extract.blocks(page), None) == "Head&line\nOne two three four\nfive <x>\na\nb\ntail"
    assert html_extract.blocks("") == [] and html_extract.blocks("<<p") == [("open", "<<p")]
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert html_extract.blocks(deep) == [("open", "x")]


def test_html_shared_lines():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        gone = html_extract.shared_lines(a, b)
        assert len(gone) == table[-1][-1]
        it = iter(b)
        assert all(a[i] in it for i in sorted(gone))


def test_html_pairs(spark):
    site = lambda own: f"<body><div>Site</div><div>{own}</div><div>Contact</div></body>"
    rows = [
        (1, "http://h.org/a/1", site("one")), (2, "https://h.org/a/2?x=1", site("two")), (3, "http://other.org/", site("three")), (4, None, None),
        (5, "http://h.org/a/1", site("one")), (6, "http://[bad", "<p>x"), (7, "http://h.org/b", "<article>same</article>"), (8, "http://h.org/b", "<article>same</article>"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {1: "one", 2: "two", 3: "Site\nthree\nContact", 4: "", 5: "one", 6: "x", 7: "same", 8: "same"}
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_pairs_across_ranges(spark):
    site = lambda own: f"<body><div>Site</div><div>{own}</div><div>Contact</div></body>"
    rows = [(i, f"http://h.org/a/{i:02d}", site(f"own {i}")) for i in range(12)] + [(50, "http://i.org/", site("alone"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = {i: f"own {i}" for i in range(12)} | {50: "Site\nalone\nContact"}
    try:
        for parts in (1, 5, 40):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            assert {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()} == want, parts
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_html_long_pages(spark):
    long = "word " * 200_000
    rows = [(1, "http://h/1", f"<main><p>{long}</main>"), (2, "http://h/x/2", f"<div>{long}</div><div>Menu</div>"), (3, "http://h/x/3", "<div>Menu</div>" * 3000 + "<div>own</div>"), (None, "http://h/4", "<p>x")]
    df = spark.createDataFrame([(*r, "a", 2) for r in rows], "page_id long, url string, html string, place string, part int")
    got = {r["page_id"]: (r["n_chars"], r["text"]) for r in html_extract.extract(df).collect()}
    assert got[1] == (len(long) - 1, long[:-1]) and got[2] == (len(long) - 1, long[:-1]) and got[3][1].endswith("own") and got[None] == (1, "x")


def test_html_differencing_is_brute_force(spark):
    """Pages without a main zone, on several hosts and whatever the ranges: what a page shares with its nearest neighbour goes."""
    rng = random.Random(4)
    rows, lines = [], {}
    for i in rng.sample(range(300), 60):
        host, path = f"h{rng.randint(0, 3)}.org", "/".join(rng.choice(["a", "b", "cc", "d"]) for _ in range(rng.randint(1, 3)))
        body = [rng.choice(["Site", "Menu", "News", "Foot"]) if rng.random() < 0.5 else f"own {i} {k}" for k in range(rng.randint(1, 9))]
        tags = [rng.choice(["div", "nav", "p"]) for _ in body]
        rows.append((i, f"https://{host}/{path}", "<body>" + "".join(f"<{t}>{x}</{t}>" for t, x in zip(tags, body)) + "</body>"))
        lines[i] = [*zip(body, tags)]

    def place(r):
        return r[1].partition("://")[2].encode(), hashlib.sha256(r[2].encode()).digest(), r[0]

    def common(a, b):
        table = [[()] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x in range(len(a)):
            for y in range(len(b)):
                table[x + 1][y + 1] = (*table[x][y], x) if a[x] == b[y] else max(table[x][y + 1], table[x + 1][y], key=len)
        return table[-1][-1]

    order, want = sorted(rows, key=place), {}
    for k, r in enumerate(order):
        host = r[1].split("/")[2]
        sides = (next((x for x in side if x[2] != r[2]), None) for side in (reversed(order[:k]), order[k + 1 :]))
        near = [x for x in sides if x and x[1].split("/")[2] == host]
        alike = lambda x: len(html_extract.commonprefix([r[1].split(host)[1], x[1].split(host)[1]]))
        mate = max(near, key=alike, default=None)
        mine = [t for t, _ in lines[r[0]]]
        want[r[0]] = (sum(tag != "nav" for _, tag in lines[r[0]]), len(common(mine, [t for t, _ in lines[mate[0]]])) if mate else 0, mine)
    try:
        results = []
        for parts in (1, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
            results.append({r["page_id"]: r["text"].split("\n") if r["text"] else [] for r in html_extract.extract(df).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
    for i, kept in results[0].items():
        n_open, n_shared, mine = want[i]
        assert [t for t in kept if t.startswith("own")] == [t for t, tag in lines[i] if tag != "nav" and t.startswith("own")]
        shown = iter(mine)
        assert all(t in shown for t in kept) and n_open - n_shared <= len(kept) <= n_open


def test_utf8_views():
    a = pa.array(["x", None, "é", ""]).slice(1)
    raw, at = utf8(a)
    assert raw.tobytes() == "é".encode() and at.tolist() == [0, 0, 2, 2]
