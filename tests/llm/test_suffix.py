"""Suffix arrays, common prefixes and the removal of repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from corpusloom.llm import suffix


@pytest.mark.parametrize("few", [3, 1024])
def test_suffix_array(monkeypatch, few):
    monkeypatch.setattr(suffix, "FEW", few)
    rng = random.Random(1)
    for _ in range(200):
        top = rng.choice([1, 2, 3, 10, 250])
        t = [rng.randint(1, top) for _ in range(rng.randint(0, 70))] + [0]
        a = np.array(t, np.uint16)
        sa = suffix.suffix_array(a, top + 1)
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert sa.tolist() == want
        shared = suffix.common_prefixes(a, sa, np.arange(len(t), 0, -1))
        for x, y in zip(want, want[1:]):
            n = 0
            while max(x, y) + n < len(t) and t[x + n] == t[y + n]:
                n += 1
            assert shared[y] == n


def test_repeated():
    rng = random.Random(2)
    for _ in range(300):
        length = rng.choice([2, 3, 5])
        contexts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 8))]
        seen = set()
        for c, got in zip(contexts, suffix.repeated(contexts, length), strict=True):
            want = []
            for i in range(len(c) - length + 1):
                if c[i : i + length] in seen:
                    want.append(i)
                seen.add(c[i : i + length])
            assert got.tolist() == want


def test_anchors_follow_from_the_string():
    rng = random.Random(3)
    piece = bytes(rng.choice(b"abcd") for _ in range(140))
    texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 300))) + piece + bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 300))) for _ in range(6)] + [b"x" * 99, b"", b"y" * 400]
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text, low, off, wide, gram, _ = suffix.contexts(raw, at, 100, 40)
    anchors = {}
    for t, a, o, w, g in zip(text.tolist(), low.tolist(), off.tolist(), wide.tolist(), gram.tolist()):
        for s in range(a, a + w + 1):
            anchors.setdefault(texts[t][s : s + 100], set()).add((g, a + o - s))
    assert all(len(x) == 1 for x in anchors.values())
    assert sum(wide + 1) == sum(max(0, len(t) - 99) for t in texts)


def brute(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                hit[k : k + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, h in zip(b, hit) if not h)
        out[i] = (len(b), sum(hit), len(bytes(hit).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length,gram,crowd", [(100, 40, 64), (100, 40, 1), (12, 5, 64), (12, 5, 1), (13, 6, 1), (7, 6, 1), (6, 6, 64)])
def test_removal(spark, monkeypatch, length, gram, crowd):
    monkeypatch.setattr(suffix, "CROWD", crowd)
    rng = random.Random(length)
    words = ["ab", "é", "cd ", "the ", "\n", "日"]
    text = lambda n: "".join(rng.choice(words) for _ in range(n))
    passages = [text(120) for _ in range(4)]
    rows = []
    for i in rng.sample(range(400), 120):
        kind = rng.randint(0, 5)
        body = text(rng.choice([0, 3, 60, 300]))
        if kind < 3:
            body += rng.choice(passages) + text(rng.choice([0, 40]))
        elif kind == 3 and rows:
            old = [*(rng.choice(rows)[1] or "")]
            for _ in range(rng.randint(0, 2)):
                if old:
                    old[rng.randrange(len(old))] = "Z"
            body = "".join(old)
        rows.append((i, body))
    rows += [(1000, None), (1001, ""), (1002, "-" * 5000), (1003, "-" * 5000 + "x"), (None, passages[0]), (1004, "x" * (length - 1)), (1005, "word " * 40_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, low int").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.find(df, length=length, gram=gram).collect()}
    assert got == brute(rows, length)


@pytest.mark.parametrize("crowd", [2, 64])
def test_small_shards(spark, monkeypatch, crowd):
    """Contexts of passages in many places, with crowded anchors split and not."""
    monkeypatch.setattr(suffix, "CROWD", crowd)
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(80)) + passage[rng.randint(0, 99) :] + str(i)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.find(df).collect()}
    assert got == brute(rows, 100)


def test_equal_ids(spark):
    rng = random.Random(4)
    t = "".join(rng.choice("abcdefgh ") for _ in range(500))
    df = spark.createDataFrame([(1, t), (1, t), (1, t[:300] + "!"), (2, t[100:400]), (2, None)], "doc_id long, text string")
    out = sorted((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffix.find(df).collect())
    # The equal rows of 1 are one document; of it and the other row of 1, one is the earlier.
    ones = [x for x in out if x[0] == 1]
    assert ones in ([(1, 301, 0), (1, 500, 300), (1, 500, 300)], [(1, 301, 300), (1, 500, 0), (1, 500, 0)])
    assert out[3:] == [(2, 0, 0), (2, 300, 300)]
    assert suffix.find(df.limit(0)).count() == 0
