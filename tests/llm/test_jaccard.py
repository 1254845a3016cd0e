"""N-gram Jaccard join and components against brute force."""

import random
import re

import numpy as np
import pytest

from corpusloom.llm import jaccard
from corpusloom.llm.components import components


def brute(rows, percent=90, n=3):
    """doc_id to (set size, least linked doc_id)."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n_words, groups):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(n_words)]
    rows = []
    passage = [rng.choice(words) for _ in range(40)]
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 9, 11, 12, 13, 30, 60, 150]))]
        if rng.random() < 0.3:
            base = base + passage
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            copy = [*base]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5]) if len(copy) > 11 else rng.choice([0, 0, 0, 1])):
                k = rng.randrange(len(copy))
                if rng.random() < 0.5:
                    copy[k] = rng.choice(words)
                else:
                    del copy[k : k + 1]
                    copy = copy or ["x"]
            rows.append((len(rows) * 3 % 1009, rng.choice([" ", "\n", "\t "]).join(rng.choice([w, w.upper()]) for w in copy)))
    return rows


@pytest.mark.parametrize("seed,n_words,classes", [(1, 3000, jaccard.CLASSES), (2, 3000, ((2, 2), (5, 3))), (3, 12, ((3, 2), (6, 3)))])
def test_components_of_documents(spark, seed, n_words, classes):
    rows = corpus(seed, n_words, 60) + [(2000, None), (2001, ""), (2002, " \n"), (2003, "a b"), (2004, "A  B"), (2005, "b a"), (2006, "é\xa0é x"), (2007, "word " * 20_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(df, classes=classes).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("classes", [jaccard.CLASSES, ((2, 2), (5, 3))])
def test_five_words(spark, classes):
    rows = corpus(4, 3000, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(df, words=5, percent=80, classes=classes).collect()}
    assert got == brute(rows, 80, 5)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (5, "x y z"), (None, None)], "doc_id long, text string")
    out = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_components(df).collect()), key=str)
    assert out == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (5, 1, 5), (None, 0, None)], key=str)
    assert jaccard.join_components(df.limit(0)).count() == 0


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out, out.translate(str.maketrans("ab", "ba"))


def test_words_decide(spark):
    """Words that collide modulo 2^64 are other words, and sets of equal shingles in another order are equal sets."""
    x, y = thue_morse(2048)
    rows = [(1, x), (2, y), (3, f"{x} b c d e"), (4, f"{y} b c d e"), (5, "p q r p q r"), (6, "p q r p q"), (7, "P  q r p\nq R p q")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, digest int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(df).collect()}
    assert got == brute(rows)
    assert got[2] == (1, 2) and got[7] == (3, 5)


def test_ids_repeat_and_lack(spark):
    rows = [(None, "a b c d"), (None, "x y z w"), (4, "a b c d"), (4, "m n o p"), (None, "x y z w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_components(df).collect()), key=str)
    assert got == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 2, None), (None, 2, None)], key=str)


def test_every_link_shares_an_entry():
    """The prefixes' guarantee, for random order and classes: linked sets share an index entry."""
    rng = np.random.default_rng(7)
    tokens = np.unique(rng.integers(1, 1 << 63, 900, dtype=np.uint64))
    df = rng.choice([1, 40, 2000], len(tokens), p=[0.3, 0.4, 0.3])
    shift = np.uint64(64 - jaccard.TOKEN_BITS)
    often = df > 1
    prefixes = jaccard.Prefixes(tokens[often] >> shift, df[often])
    linked = 0
    for _ in range(600):
        n = int(rng.integers(9, 160))
        x = np.sort(rng.choice(tokens, n, replace=False))
        y = x[rng.random(n) > rng.choice([0.0, 0.02, 0.05])]
        y = np.unique(np.concatenate([y, rng.choice(tokens, int(rng.integers(0, 1 + n // 15)))]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 90 * (len(x) + len(y) - both):
            linked += 1
            need = -(-90 * (len(x) + len(y)) // 190)
            met = [e[m <= len(z) - need] for z in (x, y) for e, m, _ in [prefixes.entries(z)]]
            assert len(np.intersect1d(*met))
    assert linked > 150


def test_counts(spark):
    rows = [(f"a b c {i}",) for i in range(40)] + [("a b c",)] * 10 + [(None,)]
    df = spark.createDataFrame(rows, "text string").repartition(3)
    tokens, df_ = jaccard.frequent(df, "text", 3, 32)
    assert df_.tolist() == [50] and len(tokens) == 1
    packed = [*jaccard._packets(np.array([5 << 24, 5 << 24, 9 << 24, 1 << 62, (1 << 64) - 1], np.uint64), 4)]
    assert [(p, *(x.tolist() for x in jaccard._unpacked(b))) for p, b in packed] == [(0, [5, 9], [2, 1]), (1, [1 << 38], [1]), (3, [(1 << 40) - 1], [1])]


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    root = {i: i for e in edges for i in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_only(spark):
    """No column of links: those inside a component are not all looked for."""
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert jaccard.join_components(df).columns == ["doc_id", "n_shingles", "component_id"]
