"""Byte-level BPE and conversation repair against the library and brute force."""

import hashlib
import itertools
import os
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest

from corpusloom.llm import bpe, queries, repair

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    own = bpe.ranks()
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.rank, special_tokens={})


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def test_bpe_ids_are_the_library_s(library):
    own, theirs = library
    rnd = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "é", "漢", "'s", "'", "1", "٣", " ", "　", "\u0085", "<|endoftext|>", "the", "ing", "😀", "A", "\0"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(4000)] + ["", " ", "a" * 3000, "ab" * 2000, "é" * 1500, " \n" * 900]
    wanted = theirs.encode_ordinary_batch(texts)
    assert [ids_of(x) for x in own.encode(texts)] == wanted
    assert [own.decode(np.array(x, np.int64)).decode() for x in wanted] == texts


def test_bpe_splits_code_points_as_the_library(library):
    """Every code point where the category changes, and every 64th."""
    own, theirs = library
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 64 == 0 or unicodedata.category(chr(c)) != unicodedata.category(chr(c - 1)))]
    texts = [f"ab{chr(c)}{chr(c)}b 1 {chr(c)}1" for c in points]
    assert [ids_of(x) for x in own.encode(texts)] == theirs.encode_ordinary_batch(texts, num_threads=2)


def test_bpe_stacked_trees_and_single_ones_agree(library):
    own, theirs = library
    rnd = random.Random(6)
    pieces = [bytes(rnd.choice(b"theinganr \xc3\xa9") for _ in range(rnd.randrange(1, 33))) for _ in range(2000)]
    wanted = [own.tree(p) for p in pieces]
    for bits in range(1, 6):
        some = [i for i, p in enumerate(pieces) if max(1, (len(p) - 1).bit_length()) == bits]
        assert own.trees([pieces[i] for i in some], bits) == [wanted[i] for i in some]

    def plain(piece):  # merge the leftmost pair of least rank, again and again
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while True:
            found = min(((own.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in own.rank), default=None)
            if found is None:
                return [own.rank[p] for p in parts]
            parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]

    assert [ids_of(x) for x in wanted[:300]] == [plain(p) for p in pieces[:300]]


def test_bpe_long_texts_are_split_at_sure_places(library, monkeypatch):
    own, theirs = library
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(["a", " ", "  ", "\n", "'s", "é", "1", "\x1d", "!"]) for _ in range(200)) for _ in range(300)]
    monkeypatch.setattr(bpe, "WINDOW", 5)
    assert [ids_of(x) for x in own.encode(texts)] == theirs.encode_ordinary_batch(texts)


def test_bpe_table_of_pieces_is_bounded(library, monkeypatch):
    own, theirs = library
    monkeypatch.setattr(bpe, "KEPT", 50)
    texts = [f"word{k} and {k * 7919} more{k % 3}" for k in range(200)]
    for k in range(0, 200, 20):
        assert [ids_of(x) for x in own.encode(texts[k : k + 20])] == theirs.encode_ordinary_batch(texts[k : k + 20])
        assert len(own.kept) <= 100


def test_bpe_rows(spark, library):
    own, theirs = library
    rows = [(None, "some words", "x", 1), (1, None, "x", 2), (1, "", "x", 3), (2, "ties ties ties", "x", 4), (2, "ties ties ties", "x", 5), (3, "a" * 2_000_000, "x", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    out = bpe.decode(bpe.encode(docs)).collect()
    assert len(out) == len(rows)
    for row, (doc_id, text, *_) in zip(sorted(out, key=lambda r: (r["doc_id"] or 0, bytes(r["decoded"]))), sorted(rows, key=lambda r: (r[0] or 0, (r[1] or "").encode())), strict=True):
        assert row["doc_id"] == doc_id and bytes(row["decoded"]) == (text or "").encode()
        assert ids_of(row["ids"]) == theirs.encode_ordinary(text or "") and row["n_tokens"] == len(row["ids"]) // 4
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0
    with pytest.raises((ValueError, IndexError)):
        own.decode(np.array([len(own.lengths)]))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_op12_whole_table(spark, library):
    _, theirs = library
    found = {r["doc_id"]: r for r in queries.QUERIES["op12_byte_bpe"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        ids = theirs.encode_ordinary(d["text"] or "")
        r = found[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


BLANK = " \t\n\x0b\f\r"


def brute(rows):
    """One conversation's report from rows (turn, role, text), by trying edits turn by turn over the roles said so far."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(BLANK)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    # What has been said decides what may follow: nothing, s, ..u or ..a.
    says = lambda state, role: {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}.get(role, {}).get(state)

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for state, (cost, audit, said) in list(out.items()):
                for role in ("user", "assistant"):
                    then = says(state, role[0])
                    if then is not None:
                        new = (cost + 3, audit + "I", [*said, f"{role}:"])
                        if then not in out or new[:2] < out[then][:2]:
                            out[then] = new
        return out

    states = inserted({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        out = {}
        for state, (cost, audit, said) in states.items():
            options = [(state, 4, "D", [])]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                options.append((says(state, role[:1]), more, "K", [f"{role}:{text}"]))
                options += [(says(state, r[0]), 3 + more, "R", [f"{r}:{text}"]) for r in ("user", "assistant")]
            for then, c, letter, line in options:
                new = (cost + c, audit + letter, said + line)
                if then is not None and (then not in out or new[:2] < out[then][:2]):
                    out[then] = new
        states = inserted(out)
    cost, audit, said = min((states[s] for s in ("", "a") if s in states), key=lambda x: x[:2])
    turns = [t for t, *_ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def damaged(rows):
    space = lambda x: " " if x is None else x
    out = []
    for conv, turn, role, text in rows:
        role, text = space(role), space(text)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def reports(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, c int")
    out = repair.digests(repair.repair(frame)).collect()
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in out}


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return out


def some_rows(seed, sizes):
    rnd, rows = random.Random(seed), []
    for conv, n in enumerate(sizes):
        for k in range(n):
            turn = None if rnd.random() < 0.1 else k if rnd.random() < 0.8 else rnd.randrange(n + 3)
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown", "é"])
            text = rnd.choice(["Yes.", "Yes.", "no", f"t{rnd.randrange(9)}!", f"long {k}? \n", " ", "", None, "\x0b.", "\u00a0", f"x{k}."])
            rows.append((conv or None, turn, role, text))
    rnd.shuffle(rows)
    return rows


def test_every_edit_of_few_turns():
    """The products against all audits of up to three turns."""
    legal = re.compile("(s?(ua)+)?")
    for n in range(4):
        for symbols in itertools.product("suaoSUAOx", repeat=n):
            best = None
            choices = [["D"] if s == "x" else ["D", "Ru", "Ra"] + ([f"K{s.lower()}"] if s.lower() in "sua" else []) for s in symbols]
            gaps = ["", "u", "a", "ua", "au"]
            for edits in itertools.product(*choices):
                for ins in itertools.product(gaps, repeat=n + 1):
                    said = ins[0] + "".join(e[1:] + i for e, i in zip(edits, ins[1:], strict=True))
                    if legal.fullmatch(said):
                        cost = sum({"D": 4, "R": 3, "K": 0}[e[0]] + (3 if e != "D" and s.isupper() else 0) for e, s in zip(edits, symbols, strict=True)) + 3 * sum(map(len, ins))
                        audit = "I" * len(ins[0]) + "".join(e[0] + "I" * len(i) for e, i in zip(edits, ins[1:], strict=True))
                        best = min(best or (cost, audit), (cost, audit))
            assert repair.cheapest(repair.fold("".join(symbols))) == best


def test_products_do_not_depend_on_the_tree():
    rnd = random.Random(3)
    for _ in range(200):
        symbols = "".join(rnd.choice("suaoSUAOx") for _ in range(rnd.randrange(1, 40)))
        steps = [repair.turn_matrix(s) for s in symbols]
        left = repair.ONE
        for m in steps:
            left = repair.times(left, m)
        right = repair.ONE
        for m in reversed(steps):
            right = repair.times(m, right)
        assert left == right == repair.fold(symbols) == repair.product(steps)


def test_repair_against_brute_force(spark):
    rows = some_rows(1, [random.Random(2).randrange(1, 14) for _ in range(150)])
    wanted = {conv: brute(its) for conv, its in by_conversation(rows).items()}
    assert reports(spark, rows) == wanted


def test_repair_of_long_conversations(spark, monkeypatch):
    """Small blocks, few to a product: many blocks and several rounds, over partitions too."""
    monkeypatch.setattr(repair, "FAN", 2)
    rows = some_rows(4, [600, 3, 90, 1, 250])
    wanted = {conv: brute(its) for conv, its in by_conversation(rows).items()}
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        repaired = repair.repair(frame, most=7, size=200)
        assert repaired.parts.count() > 30
        found = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.digests(repaired).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert found == wanted


def test_repair_of_hot_and_odd_rows(spark):
    rows = [(1, 5, "user", "Same.")] * 300 + [(1, k, "user", "Same.") for k in range(300)] + [(2, None, None, None)] * 3 + [(3, 2**40, "user", "x" * 3_000_000 + "."), (3, -(2**40), "assistant", "b.")]
    wanted = {conv: brute(its) for conv, its in by_conversation(rows).items()}
    assert reports(spark, rows) == wanted
    assert reports(spark, []) == {}


def test_damage_and_query(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, *range(6)]), rnd.choice(["user", "assistant", "system", None]), rnd.choice(["A. b? c!", "d", None, ""])) for _ in range(600)] + [(77, 3, "user", "x.")]
    gone = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "dropped."))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    its = by_conversation(damaged(rows))
    wanted = {conv: brute(its[conv]) if conv in its else (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for conv in by_conversation(rows)}
    assert gone not in its and found == wanted
