"""Embedding, enrichment and answering behind small interfaces, with offline stand-ins."""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


class HashEmbedder:
    """Vectors from sha256: pairs of digest bytes over 65536, scaled to length 1. A blank text has none."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        return [self._one(t) if t and t.strip() else None for t in texts]

    def _one(self, text: str) -> list[float]:
        need, raw, i = 2 * self.dim, b"", 0
        while len(raw) < need:
            raw += hashlib.sha256(text.encode() + (i.to_bytes(4, "big") if i else b"")).digest()
            i += 1
        v = np.frombuffer(raw[:need], ">u2") / 65536
        return (v / np.linalg.norm(v)).astype(np.float32).tolist()


class Retrying:
    """An embedder that is asked again, after each of WAITS seconds, and whose failing batches are then asked text by text."""

    WAITS = (0.1, 0.5, 2.0)

    def __init__(self, inner: Embedder, waits: tuple[float, ...] = WAITS):
        self.inner, self.waits, self.dim = inner, waits, inner.dim

    def _tried(self, texts: list[str]) -> list[list[float] | None]:
        for wait in (*self.waits, None):
            try:
                out = self.inner.embed(texts)
                if len(out) != len(texts):
                    raise ValueError(f"{len(out)} vectors for {len(texts)} texts")
                if all(v for v, t in zip(out, texts, strict=True) if t and t.strip()) or wait is None:
                    return out
            except Exception:
                if wait is None:
                    raise
            time.sleep(wait)
        raise AssertionError

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        try:
            return self._tried(texts)
        except Exception:
            if len(texts) == 1:
                raise
            return [self._tried([t])[0] for t in texts]


class Caching:
    """An embedder that keeps the vectors of its last texts, by their sha256; what was taken in first goes first."""

    def __init__(self, inner: Embedder, most: int = 512):
        self.inner, self.most, self.dim, self.held = inner, most, inner.dim, OrderedDict()

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        keys = [hashlib.sha256((t or "").encode()).digest() for t in texts]
        known = {k: self.held[k] for k in keys if k in self.held}
        new = {k: t for k, t in zip(keys, texts, strict=True) if k not in known}
        found = dict(zip(new, self.inner.embed([*new.values()]), strict=True)) if new else {}
        for k, v in found.items():
            while len(self.held) >= self.most:
                self.held.popitem(last=False)
            self.held[k] = v
        known |= found
        return [known[k] for k in keys]


def embedded(rows: DataFrame, text: str, embedder: Embedder, into: str = "embedding") -> DataFrame:
    """rows with a vector column; each different text is embedded once, wherever its rows are. Blank texts have none."""
    key = F.sha2(F.col(text), 256)
    distinct = rows.select(key.alias("_key"), F.col(text).alias("_text")).dropDuplicates(["_key"]).select("_key", embed(F.col("_text"), embedder).alias(into))
    return rows.withColumn("_key", key).join(distinct, "_key", "left").drop("_key")


def _vectors(s: pa.Array, embedder: Embedder, batch: int) -> pa.Array:
    """The vectors of texts, equal ones embedded once; what was seen is known by its sha256, so that ``batch`` texts are held as Python strings."""
    known: dict[bytes, int] = {}
    at, found = [], [pa.array([], pa.list_(pa.float32()))]
    for i in range(0, len(s), batch):
        texts = s.slice(i, batch).fill_null("").to_pylist()
        keys = [hashlib.sha256(t.encode()).digest() for t in texts]
        new = {k: t for k, t in zip(keys, texts, strict=True) if k not in known}
        known |= {k: len(known) + n for n, k in enumerate(new)}
        if new:
            found.append(pa.array(embedder.embed([*new.values()]), pa.list_(pa.float32())))
        at += [known[k] for k in keys]
    return pa.concat_arrays(found).take(pa.array(at, pa.int64()))


def embed(text: Column, embedder: Embedder, batch: int = 200) -> Column:
    """A vector column. Equal texts of a batch of rows are embedded once, and at most ``batch`` texts at once."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in parts:
            yield _vectors(s, embedder, batch)

    return F.arrow_udf(run, "array<float>")(text)


#: What a model is told, by version; the chunk and what is around it stand at the brackets.
ASK = {
    1: "Rewrite the chunk so that it can be understood alone: put names for pronouns and vague words, from what is around it. Keep every detail, add nothing else, and give the chunk only.\n\n{}Rewritten chunk:",
    2: "Write a short note on the chunk: the things it names or refers to, with what they are, and three to five words by which one might look for it. Do not repeat the chunk, and take nothing from elsewhere.\n\n{}Note:",
}


def context(df: DataFrame, document: list[str], order: str, text: str, before: int = 3, after: int = 1) -> DataFrame:
    """df with ``previous`` and ``following``: the texts around each chunk of its document, joined by blank lines."""
    w = Window.partitionBy(*document).orderBy(order)
    return df.withColumn("previous", F.array_join(F.collect_list(text).over(w.rowsBetween(-before, -1)), "\n\n")).withColumn("following", F.array_join(F.collect_list(text).over(w.rowsBetween(1, after)), "\n\n"))


def prompt(text: Column, previous: Column, following: Column, version: int = 2) -> Column:
    """What the enriching model is asked: version 1 rewrites the chunk, 2 asks for a note to append. A side without text is left out."""
    side = lambda name, x: F.when(x != "", F.concat(F.lit(f"{name}:\n"), x, F.lit("\n\n"))).otherwise("")
    head, _, tail = ASK[version].partition("{}")
    return F.concat(F.lit(head), side("Before", previous), F.lit("Chunk:\n"), text, F.lit("\n\n"), side("After", following), F.lit(tail))


def answers(prompts: Column, model: Callable[[str], str | None]) -> Column:
    """A struct of a model's answer, and of whether it failed."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            said: list = []
            for p in s:
                try:
                    said.append((model(p), False))
                except Exception:  # a failure is a result: the chunk stays as it was
                    said.append((None, True))
            yield pd.DataFrame(said, columns=["answer", "failed"]).astype({"answer": object, "failed": bool})

    return F.pandas_udf(run, "answer string, failed boolean")(prompts)


def vector_bytes(vector: Column) -> Column:
    """A vector as little-endian 32-bit floats."""
    return F.pandas_udf(lambda s: s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes()), "binary")(vector)


def bytes_vector(raw: Column) -> Column:
    """The vector of ``vector_bytes``; bytes after the last whole float are left out."""
    return F.pandas_udf(lambda s: s.map(lambda b: None if b is None else np.frombuffer(b, "<f4", len(b) // 4).tolist()), "array<float>")(raw)


def enriched(text: Column, answer: Column, version: int = 2) -> Column:
    """The chunk with the model's answer: in its place (1) or after it (2); without an answer as it was."""
    has = F.trim(F.coalesce(answer, F.lit(""))) != ""
    return F.when(has, answer if version == 1 else F.concat(text, F.lit("\n\n"), answer)).otherwise(text)


def reuse(new: DataFrame, old: DataFrame, model: str, version: str) -> DataFrame:
    """new with the stored enrichment of the same id, text, model and prompt version, else null."""
    kept = old.where((F.col("enrichment_model") == model) & (F.col("enrichment_version") == version)).select("id", F.col("raw_content").alias("old_content"), F.col("enriched_content").alias("stored"))
    return new.join(kept, "id", "left").withColumn("enriched_content", F.when(F.col("old_content").eqNullSafe(F.col("raw_content")), F.col("stored"))).drop("old_content", "stored")
