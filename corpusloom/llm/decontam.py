r"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is ``window`` consecutive words of an item (the whole item where it has fewer words, but not none). A
document contains a window when all of the window's shingles (``SHINGLE`` neighbouring words; one word where the
window has one) follow each other in it, so the containment asked for is exact and the necessary prefix of a window
has one shingle: its rarest, by counts over all documents (ties: by the words, then by place). Only places where
such a shingle stands are looked at. The shingle's offset in its item bounds where a match can begin and end, the
match is extended word by word within these bounds, and a run of at least the window's length is a hit, so all
words of the run are hit.

The benchmark is joined in blocks of at most ``block_bytes`` of text (or a single item beyond that): each block is
counted and searched by a pass of its own, and only one block's index is broadcast at a time, so what is sent is
bounded and all items count. Between blocks the documents and what has been found are written to the shared folder, so no
task holds two indexes. The documents are never shuffled.

Nulls: a text that is null or empty, of a document or an item, has no words and no hits. Items of one id count as one; items
without an id hit as any others and count as one, whose id is the empty string. Repeated documents each give a row. A document's
length is not bounded: its words are held one document at a time. An empty benchmark hits nothing; other columns of
either table are ignored by ``find`` and kept by ``annotate``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import lean, materialise, utf8

WINDOW = 10
SHINGLE = 2
BLOCK_BYTES = 16 << 20

#: Fixed by the word pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z: all other ASCII separates.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _each(column: pa.Array) -> Iterator[list[bytes]]:
    """The words of each text of an Arrow column."""
    raw, at = utf8(column)
    raw = raw.tobytes().translate(_FOLD)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield raw[a:b].split()


def _shingles(words: list[bytes]) -> list[bytes]:
    """Each shingle as its words joined by a space; the word alone where there is but one."""
    if len(words) < SHINGLE:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def _candidates(words: list[bytes], first: frozenset, single: bool) -> list[tuple[int, bytes]]:
    """Places and shingles that may be in an index: those whose first word begins one."""
    last, out = len(words) - SHINGLE, []
    for i, w in enumerate(words):
        if w in first:
            if i <= last:
                out.append((i, w + b" " + words[i + 1]))
            if single:
                out.append((i, w))
    return out


def count_shingles(docs: DataFrame, text: str, wanted: list[bytes]) -> dict[bytes, int]:
    """How often each of the wanted shingles stands in all documents: at most as many rows as are wanted."""
    sent = docs.sparkSession.sparkContext.broadcast({s: i for i, s in enumerate(wanted)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        first, single = frozenset(s.split(b" ")[0] for s in index), any(b" " not in s for s in index)
        total: Counter = Counter()
        for batch in batches:
            for words in _each(batch.column(0)):
                total.update([index[s] for _, s in _candidates(words, first, single) if s in index])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["shingle", "n"]
        )

    rows = docs.select(text).mapInArrow(lean(run), "shingle int, n long").groupBy("shingle").agg(F.sum("n").alias("n")).collect()
    return {wanted[r["shingle"]]: r["n"] for r in rows}


class Index:
    """The rarest shingle of every window, with the items and offsets at which it stands."""

    def __init__(self, items: list[tuple[str, list[bytes]]], counts: dict[bytes, int], window: int):
        self.items, self.window = items, window
        self.places: dict[bytes, list[tuple[int, int]]] = {}
        seen = set()
        for k, (_, words) in enumerate(items):
            length = min(window, len(words))
            shingles = _shingles(words)
            per = max(1, length - SHINGLE + 1)
            order = [(counts.get(s, 0), s, q) for q, s in enumerate(shingles)]
            for a in range(len(words) - length + 1):
                _, s, q = min(order[a : a + per])
                if (k, q) not in seen:
                    seen.add((k, q))
                    self.places.setdefault(s, []).append((k, q))
        self.first = frozenset(s.split(b" ")[0] for s in self.places)
        self.single = any(b" " not in s for s in self.places)

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans of words, not merged, and ids of the items that have an occurring window."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        ended: dict[tuple[int, int], int] = {}
        n, places, items, window = len(words), self.places, self.items, self.window
        for p, s in _candidates(words, self.first, self.single):
            for k, q in places.get(s, ()):
                if ended.get((k, p - q), -1) > p:
                    continue
                name, item = items[k]
                length = min(window, len(item))
                lowest, highest = max(0, p - q), min(n, p - q + len(item))
                if highest - lowest < length:
                    continue
                a, b, shift = p, p + 1, q - p
                while a > lowest and words[a - 1] == item[a - 1 + shift]:
                    a -= 1
                while b < highest and words[b] == item[b + shift]:
                    b += 1
                ended[k, p - q] = b
                if b - a >= length:
                    spans.append((a, b))
                    found.add(name)
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(bench: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items, block by block."""
    rows = bench.where(F.col(text).isNotNull()).select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("id"), F.col(text).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = int(size // block_bytes) + 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == k)
        block = [(r["id"], w) for r in part.collect() if (w := words_of(r["t"].encode()))]
        if block:
            yield sorted(block)


FOUND = "struct<n_words:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>"
_FOUND_ARROW = pa.struct(
    [("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def annotate(docs: DataFrame, bench: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row (all columns of docs, as a struct) and found: n_words, items (ids, sorted), spans (of hit words, merged)."""
    spark = docs.sparkSession
    out = docs.select(F.struct("*").alias("row"), F.col(text).alias("t"), F.lit(None).cast(FOUND).alias("found"))
    schema = T.StructType([out.schema["row"], out.schema["t"], T.StructField("found", out.schema["found"].dataType)])
    for k, block in enumerate(chain(_blocks(bench, item, item_text, block_bytes), [[]])):  # an empty block ends them, or is the only one
        if k and not block:
            break
        if k:
            out = materialise(out, "decontam")
        wanted = sorted({s for _, words in block for s in _shingles(words)})
        sent = spark.sparkContext.broadcast(Index(block, count_shingles(docs, text, wanted) if wanted else {}, window))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                before = batch.column(2)
                known = before.to_pylist() if before.null_count < len(before) else [None] * len(before)
                found = []
                for words, old in zip(_each(batch.column(1)), known, strict=True):
                    spans, items = index.search(words) if index.places else ([], set())
                    if old:
                        spans += [(x["start"], x["end"]) for x in old["spans"]]
                        items |= set(old["items"])
                    found.append({"n_words": len(words), "items": sorted(items), "spans": [{"start": a, "end": b} for a, b in merged(spans)]})
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, _FOUND_ARROW)], ["row", "t", "found"])

        out = out.mapInArrow(lean(run), schema)
    return out.select("row", "found")


def hit_words(found) -> F.Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def find(docs: DataFrame, bench: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans of each document."""
    out = annotate(docs.select(doc_id, text), bench, text=text, **options)
    return out.select(
        F.col("row")[doc_id].alias(doc_id),
        F.col("found.n_words").alias("n_words"),
        hit_words(F.col("found")).alias("n_hit"),
        F.col("found.items").alias("items"),
        F.col("found.spans").alias("spans"),
    )


__all__ = ["annotate", "count_shingles", "find", "hit_words", "merged", "words_of"]
