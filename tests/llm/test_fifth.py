"""Pieces that the tokenizers library is asked for, and the cuts between them."""

import random

import numpy as np

from corpusloom.llm import jaccard, packing, tokens

PARTS = [" ", "  ", "\n", "\t", "\r", "a", "B", "word", "'s", "'ll", "'", "1", "é", "×", "÷", "ß", "ɏ", "ɐ", "Я", "ѿ", "҂", "҃", "\xa0", "　", "́", "​", "\x85", "!", ".", ",", "-", "日", "“", "\x1c", "\x0b", "\x7f", "\x00", "😀", "<|endoftext|>"]


def encoded(bpe, texts):
    data = [t.encode() for t in texts]
    ids, counts = bpe.encode_utf8(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def asked(bpe, monkeypatch):
    """The bytes that the library is given from now on."""
    given, own = [0], bpe._encode

    def count(texts):
        given[0] += sum(len(t.encode()) for t in texts)
        return own(texts)

    monkeypatch.setattr(bpe, "_encode", count)
    return given


def words(rng, n):
    return ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(9)) for _ in range(n)]


def test_cuts_change_no_ids(monkeypatch):
    for kept in (tokens.KEPT, 300):
        monkeypatch.setattr(tokens, "KEPT", kept)
        bpe, rng = tokens.Encoder(), random.Random(7)
        for _ in range(40):
            texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 16))) for _ in range(100)]
            assert encoded(bpe, texts) == [e.ids for e in bpe.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_a_word_is_asked_for_once(monkeypatch):
    bpe, rng = tokens.Encoder(), random.Random(8)
    given, own = asked(bpe, monkeypatch), words(rng, 2000)
    encoded(bpe, ["x " + " ".join(own), "x " + ", ".join(own), "x " + ". ".join(own) + ".", "x " + "\n ".join(own)])
    assert given[0] < 1.2 * 10 * len(own)


def test_common_words_stay_when_the_table_is_full(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 3000)
    bpe, rng = tokens.Encoder(), random.Random(9)
    common = "x " + " ".join(words(rng, 500))
    encoded(bpe, [common])
    encoded(bpe, [common])
    given, new = asked(bpe, monkeypatch), 0
    for _ in range(20):
        rare = words(rng, 400)
        new += 10 * len(rare)
        texts = [common, "x " + " ".join(rare)]
        assert encoded(bpe, texts) == [e.ids for e in bpe.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert given[0] < 1.1 * new


def test_rounds_of_parts_that_a_task_reads_are_run_once(spark, monkeypatch, tmp_path):
    """Files of parts are read in any order, many to a task: what lies between two of them is none of its work."""
    own, folder = packing.rounds, str(tmp_path)

    def counted(p, *a):
        with open(f"{folder}/calls", "a") as out:
            out.write(f"{p}\n")
        return own(p, *a)

    monkeypatch.setattr(packing, "rounds", counted)
    monkeypatch.setattr(packing, "WINDOWS", 4)
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k, None) for k in settings}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(100)), rng.choice("stuv")) for i in range(600)]
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), length=128, least=32).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    parts = -(-101 * len(rows) // (4 * 128))
    assert sum(r["length"] for r in out) == 101 * len(rows)
    assert parts <= len((tmp_path / "calls").read_text().split()) < parts + 8 * 16


def test_words_are_hashed_as_they_are_split():
    """Equal words, equal hashes, whatever their length or place; other words, other hashes."""
    rng, seen = random.Random(11), {}
    parts = ["a", "B", " ", "\n", "\x0b", "é", "abcdefgh", "x" * 17, "y" * 33, "1", "\x1c", "\x85"]
    for _ in range(200):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))).encode() for _ in range(rng.randint(0, 20))]
        at = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        hashes, counts = jaccard.word_hashes(np.frombuffer(b"".join(texts), np.uint8), at)
        words_ = [jaccard.words_of(x) for x in texts]
        assert counts.tolist() == [len(x) for x in words_]
        assert all(seen.setdefault(h, w) == w for h, w in zip(hashes.tolist(), [w for x in words_ for w in x], strict=True))
    assert len({*seen.values()}) == len(seen)
