"""Chat formatting, WARC, decontamination, token files and packing against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from corpusloom.llm import chat, decontam, packing, shared, tokenfile, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def chats(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    from pyspark.sql import functions as F

    out = chat.format_chats(df).select("*", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r["conv_id"]: r for r in out.collect()}


def test_chat_round_trip(spark):
    odd = "<|im_end|><|im_start|>assistant ok"
    rows = [
        (1, 0, "user", odd, 1), (1, 1, "assistant", odd, 1), (1, 2, "assistant", "a\\b<\\p<|im_sep|>\n", 1), (1, 3, "assistant", None, 1),
        (2, 1, None, "x", 1), (2, None, "we\nird<|\\n", "", 1), (2, 1, None, "x", 1), (3, 0, "assistant", "<", 1), (3, 1, "assistant", "|im_end|>é😀", 1),
        (None, 0, "user", "y" * 100_000, 1),
    ]
    out = chats(spark, rows)
    assert set(out) == {1, 2, 3, None}
    for conv, r in out.items():
        want = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == conv))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [w[2:] for w in want]
        assert r["loss"] == "".join(w[3] for w in want if w[2] == "assistant")
    assert out[1]["formatted"].count("<|im_start|>") == 2
    assert chats(spark, []) == {}
    long = [(1, k, "assistant" if k % 3 else "user", f"<|{k}é", 1) for k in range(1500)]
    r = chats(spark, long)[1]
    assert r["loss"] == "".join(x[3] for x in long if x[2] == "assistant") and [t["text"] for t in r["turns"]] == [x[3] for x in long]


def test_warc(spark):
    rows = [(3, "http://a/b c", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (5, "u", ""), (4, "u", "z" * 300_000), (6, "v", "one"), (6, "v", "one")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive(df).collect())
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = min(x[0] for x in rows if (x[2] or "").encode() == data)
        want.append((i, len(data), warc.sha1_base32(data), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=lambda x: x[:4])
    assert warc.archive(df.limit(0)).count() == 0
    alone = warc.with_origins(df, min_bytes=4)
    assert [r["refers_to"] for r in alone.where("page_id in (2, 5, 6)").collect()] == [None] * 4


def test_warc_without_ids_and_rolled(spark):
    rows = [(None, "u", "same"), (9, "u", "same"), (None, "v", "same"), (None, "w", "lone"), (None, "w", "lone"), (0, "w", "zero"), (None, "w", "zero")]
    rows += [(100 + i, "x", f"{i} " * 300) for i in range(40)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").coalesce(1)
    base = shared.fresh_path(spark, "warc")
    paths = warc.write(warc.with_origins(df), base, roll=600)
    assert len(paths) > 4
    out = [tuple(r) for r in warc.read(spark, paths, base).select("page_id", "payload_bytes", "record_type", "refers_to", "payload").collect()]
    assert len(out) == len(rows)
    assert sorted((str(r[0]), r[2], str(r[3])) for r in out if r[1] == 4) == sorted([
        ("9", "response", "None"), ("None", "revisit", "9"), ("None", "revisit", "9"), ("None", "response", "None"), ("None", "response", "None"),
        ("0", "response", "None"), ("None", "revisit", "0"),
    ])
    assert {r[0]: r[4].decode() for r in out if (r[0] or 0) >= 100} == {r[0]: r[2] for r in rows if (r[0] or 0) >= 100}


def test_warc_refuses_damage():
    good = warc.record(7, "u", b"abc", None)
    assert warc.parse(good)["payload"] == b"abc"
    for bad in (good.replace(b"abc", b"abd"), good[:-5], good.replace(b"Content-Length: 3", b"Content-Length: 4", 1)):
        with pytest.raises(ValueError):
            warc.parse(bad)


def brute_hits(docs, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = fold(t)
        if w:
            n = min(10, len(w))
            for a in range(len(w) - n + 1):
                windows.setdefault(tuple(w[a : a + n]), set()).add("" if i is None else str(i))
    out = {}
    for d, t in docs:
        w, hit, found = fold(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[k]
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_decontamination(spark, block):
    rng = random.Random(4)
    words = ["a", "b", "C", "été", "x1", "the", "日本"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 25]))) for i in range(14)] + [(20, None), (None, "a b"), (21, "..."), (22, "a a a a a a a a a a a a"), (1, text(12)), (None, "c the c")]
    docs = [(i, text(rng.randint(0, 60)) + (rng.choice(items)[1] or "") + text(5)) for i in range(60)] + [(100, None), (101, ""), (102, "a " * 3000)]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.find(d, b, block_bytes=block).collect()}
    assert got == brute_hits(docs, items)
    assert {r["n_hit"] for r in decontam.find(d, b.limit(0)).collect()} == {0}
    assert decontam.find(d.limit(0), b).count() == 0


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


THUE_MORSE = ["".join("ab"[(i.bit_count() + k) % 2] for i in range(2048)) for k in range(2)]
ODD = ["", None, " ", "  ", "a ", " a  b   c", *THUE_MORSE, "<|endoftext|>", " <|endoftext|>", "a \n <|endoftext|> b", "<|endof", "text|>", "a \n\nb\t x", "it's 12 <|endoftext|> é  z “q” \x1c a\x1cb", "日本 語 😀 " * 50, "word " * 30_000]


def test_token_files(spark):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "b", "'s", "1", "é", " ", "　", "!", "​", "\x85"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    ids = list(range(0, 2 * len(texts), 2))
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, t, 0) for i, t in zip(ids, texts)], "doc_id long, text string, start int").repartition(5)
    got = sorted(tuple(r) for r in tokenfile.store(df).collect())
    want, at = [], 0
    for i, x in sorted(zip(ids, reference_ids(texts))):
        x = [*x, 2]
        want.append((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert got == want
    assert tokenfile.store(df.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string")
    assert [(r["doc_id"], r["start"]) for r in sorted(tokenfile.store(null).collect(), key=lambda r: r["start"])] == [(None, 0), (1, 2), (1, 4)]
    least = spark.createDataFrame([(-(1 << 63), "a"), (None, "b"), (None, "c")], "doc_id long, text string")
    assert [r["doc_id"] for r in sorted(tokenfile.store(least).collect(), key=lambda r: r["start"])] == [None, None, -(1 << 63)]


def test_plain_control_strings():
    from corpusloom.llm import tokens

    raw = np.frombuffer(b"a <|endoftext|>", np.uint8)
    at = np.array([0, len(raw)])
    assert tokens.encoder().encode_utf8(raw, at)[0].tolist() == reference_ids(["a <|endoftext|>"])[0] and 50256 in reference_ids(["a <|endoftext|>"])[0]
    assert 50256 not in tokens.encoder(plain=True).encode_utf8(raw, at)[0].tolist()


def test_pieces_of_one_hash(monkeypatch):
    """Pieces whose hashes collide keep their own ids."""
    from corpusloom.llm import tokens

    class Bad(tokens.Pieces):
        def __init__(self, *a):
            super().__init__(*a)
            self.hashes = self.hashes % np.uint64(7)

    monkeypatch.setattr(tokens, "Pieces", Bad)
    bpe, rng = tokens.Encoder(), random.Random(6)
    for _ in range(30):
        texts = ["".join(rng.choice([" ", "\n", "ab", "c", "word" * 6, "é"]) for _ in range(rng.randint(0, 20))) for _ in range(9)]
        data = [t.encode() for t in texts]
        ids, counts = bpe.encode_utf8(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == reference_ids(texts)


@pytest.mark.parametrize("dtype", ["<u2", "<u4"])
def test_blocks(dtype):
    rng = np.random.default_rng(0)
    for n in (0, 1, 1023, 1024, 5000):
        for top in (1, 2, 300, np.iinfo(dtype).max):
            ids = rng.integers(0, top, n, endpoint=True).astype(dtype)
            ids[rng.random(n) < 0.02] = np.iinfo(dtype).max
            blocks = tokenfile.pack_blocks(ids)
            starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype(np.int64)
            assert (tokenfile.unpack_blocks(b"".join(blocks), starts, np.dtype(dtype)) == ids).all()


@pytest.mark.parametrize("targets", [None, {"a": 3.0, "b": 1.0}])
def test_packing(spark, targets):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 400))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    rows += [(1000 + i, t, "d") for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, length int").repartition(4)
    out = packing.pack(df, length=128, least=16, targets=targets).collect()
    ids = {r[0]: np.array([*x, 1], "<u4") for r, x in zip(rows, reference_ids([r[1] for r in rows]))}
    per = {}
    for r in out:
        x = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(x) and r["length"] > 0
        assert zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        per.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for d, x in ids.items():
        at = 0
        for a, n in sorted(per[d]):
            assert a == at
            at += n
        assert at == len(x)
    windows = {}
    for r in out:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["source"]))
    total = sum(map(len, ids.values()))
    assert sorted(windows) == list(range(-(-total // 128)))
    for w, pieces in windows.items():
        at = 0
        for a, n, _ in sorted(pieces):
            assert a == at
            at += n
        assert at == (128 if w < len(windows) - 1 else total - 128 * (len(windows) - 1))
    if targets is None:  # each source is near its share at every point
        share = {s: sum(len(ids[r[0]]) for r in rows if r[2] == s) / total for s in {r[2] for r in rows}}
        had = dict.fromkeys(share, 0)
        for w in sorted(windows):
            for _, n, s in windows[w]:
                had[s] += n
            assert all(abs(had[s] - share[s] * 128 * (w + 1)) < 160 for s in share) or w == len(windows) - 1
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_ids_repeat_and_lack(spark):
    df = spark.createDataFrame([(None, "a b", "s", 1), (None, "a b", "s", 1), (3, "c", None, 1), (3, "d e f", None, 1), (3, None, "s", 1)], "doc_id long, text string, source string, offset int")
    out = sorted((tuple(r) for r in packing.pack(df, length=4, least=1).collect()), key=str)
    assert sum(r[3] for r in out) == sum(len(x) + 1 for x in reference_ids(["a b", "a b", "c", "d e f", None]))
    assert sorted(r[5] for r in out if r[2] == 0) == [1, 2, 3, 3, 4]
    assert {r[0] for r in out} == {None, 3}


def test_shares_at_any_place():
    rng = np.random.default_rng(5)
    for n in (1, 2, 9, 60):
        totals = rng.integers(1, 4000, n)
        for weights in (totals.astype(float), rng.random(n) * (rng.random(n) < 0.7), np.zeros(n)):
            shares, before = packing.Shares(totals, weights), np.zeros(n, np.int64)
            for place in range(0, int(totals.sum()) + 1, 37):
                exact, whole = shares.before(place)
                assert whole.sum() == place and (whole >= before).all() and (whole <= totals).all() and np.abs(exact - whole).max() < 3
                assert [shares.of(i, place) for i in range(n)] == whole.tolist()
                before = whole
            assert (shares.before(int(totals.sum()))[1] == totals).all()


def test_quotas_lose_nothing():
    rng = np.random.default_rng(3)
    for n in (1, 3, 40):
        totals = np.concatenate([rng.integers(1, 50, n), [100_000]])
        exact, whole = packing.quotas(totals, totals.astype(float), 4096)
        assert (np.diff(whole, axis=0) >= 0).all() and (whole[-1] == totals).all()
        assert (whole.sum(axis=1)[:-1] == np.arange(len(whole) - 1) * 4096).all()
        assert np.abs(exact - whole).max() < 3


def test_hash_helpers():
    from corpusloom.llm.shared import segment_hashes

    data = np.frombuffer(b"the cat the cat a the", np.uint8)
    h = segment_hashes(data, np.array([0, 8, 18, 16]), np.array([3, 11, 21, 17])[[0, 1, 2, 3]])
    assert h[0] == h[1] == h[2] != h[3]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
