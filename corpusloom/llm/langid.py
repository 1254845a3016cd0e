"""Language identification with string kernels.

Kernel: the blended spectrum of byte 1- to 3-grams by presence. A text is folded (A-Z to a-z; other ASCII than
letters to a space) and gives the set P(x) of its n-grams, each in a bucket of its length's table (the tables are
fixed in size, so that a batch of texts is a matrix of zeros and ones); K(x, z) = |P(x) & P(z)| / sqrt(|P(x)| |P(z)|).

Learner: one-versus-rest kernel ridge regression over Nystroem landmarks. At most SAMPLE documents of each language
(those of least hash of their id and text) give examples: the whole text, and a span of each of SPANS bytes from its middle,
so that short texts are learnt too. LANDMARKS examples of each language, MOST_LANDMARKS of all, are the landmarks; the weights
solve (Knm' W Knm + ridge n Kmm) a = Knm' W Y, where W gives all languages the same weight. Every language is learnt, however
many there are: the sums Knm' W Knm and Knm' W Y are made in the tasks, block by block and language by language, so that the
driver holds MOST_LANDMARKS squared numbers and MOST_LANDMARKS a language. These bounds on labelled rows are the only
sampling: everything is predicted from whole texts.

Prediction: the presence matrix of a batch times the landmarks' matrix gives kernel values, these times the weights
the languages' values; the language of the largest is predicted (ties: the first in order of name), with a score
from a softmax of the values. A text that is null or has no letter is ``und`` with score 0; so is every text where
nothing could be learnt. Rows with a null language, null text or no letter teach nothing. Rows of equal id are
predicted each. A text of any length is read whole, in pieces of bounded size. Other columns pass through ``annotate`` in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import lean, made, materialise, remove_made, utf8

SAMPLE = 600
#: Landmarks of a language, and of all languages together.
LANDMARKS, MOST_LANDMARKS = 40, 2048
#: Rows of the landmarks' matrix that a task sends at once, and languages whose bounds are broadcast.
SUMMED, SENT_LANGUAGES = 256, 50_000
SPANS = (12, 48, 240)
RIDGE = 1e-4
SHARP = 6.0
UNKNOWN = "und"
#: Buckets of 1-, 2- and 3-grams.
TABLES = (256, 4096, 16384)
WIDTH = sum(TABLES)
_FOLD = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)], np.uint8)
_BATCH_TEXTS, _BATCH_BYTES = 64, 1 << 19


def presence(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The presence matrix, texts x WIDTH, of the texts raw[at[i]:at[i+1]]. Long batches are read in pieces."""
    out = np.zeros((len(at) - 1) * WIDTH, np.float32)
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int64) * WIDTH, np.diff(at))
    for low in range(0, len(raw), _BATCH_BYTES):
        high = min(len(raw), low + _BATCH_BYTES)
        part = _FOLD[raw[low : min(len(raw), high + 2)]].astype(np.uint32)
        rows = row[low : low + len(part)]
        n = high - low
        out[rows[:n] + part[:n]] = 1
        if len(part) > 1:
            same = rows[:-1] == rows[1:]
            code = (part[:-1] << np.uint32(8)) | part[1:]
            bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
            out[(rows[:-1] + bucket + TABLES[0])[same]] = 1
        if len(part) > 2:
            same = rows[:-2] == rows[2:]
            code = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
            bucket = ((code * np.uint32(0x85EBCA6B)) >> np.uint32(18)).astype(np.int64)
            out[(rows[:-2] + bucket + TABLES[0] + TABLES[1])[same]] = 1
    return out.reshape(-1, WIDTH)


def batches(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, presence matrix) of runs of texts of bounded size."""
    low = 0
    while low < len(at) - 1:
        high = min(low + _BATCH_TEXTS, max(low + 1, int(np.searchsorted(at, at[low] + _BATCH_BYTES, "right")) - 1))
        yield low, presence(raw[at[low] : at[high]], at[low : high + 1] - at[low])
        low = high


def kernel(matrix: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of texts against landmarks, whose rows are already divided by their norms."""
    norm = np.sqrt(matrix.sum(axis=1))
    return (matrix @ landmarks.T) / np.where(norm > 0, norm, 1)[:, None]


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def values(self, matrix: np.ndarray) -> np.ndarray:
        return kernel(matrix, self.landmarks) @ self.weights


def lettered(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _examples(text: str) -> list[bytes]:
    raw = text.encode()
    middle = len(raw) // 2
    return [raw] + [raw[middle : middle + n] for n in SPANS if middle + n < len(raw)]


def _n_examples(text: Column) -> Column:
    size = F.octet_length(text)
    return 1 + sum(F.when(F.floor(size / 2) + n < size, 1).otherwise(0) for n in SPANS)


def sampled(docs: DataFrame, *, doc_id: str, text: str, lang: str, sample: int) -> DataFrame:
    """A table of lang, text and k, the place among the language's documents by the hash of id and text: at most ``sample`` of each language.
    Rows of one id and text count once."""
    rows = docs.where(F.col(lang).isNotNull() & lettered(F.col(text))).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h"))
    # A language's least hashes are looked for below a bound that a few times ``sample`` of its documents pass, so that no task
    # gathers more of a common language however many documents there are.
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    share = F.least(F.lit(1.0), F.lit(4.0 * sample + 100) / F.col("n"))
    bound = F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise((F.lit(-(2.0**63)) + share * 2.0**64).cast("long"))
    bounds = materialise(counts.select("lang", bound.alias("bound")), "langid-bounds")
    few = bounds.count() <= SENT_LANGUAGES  # beyond, rows are dealt by language
    near = rows.join(F.broadcast(bounds) if few else bounds, "lang").where(F.col("h") <= F.col("bound")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    first = Window.partitionBy("lang").orderBy("h", "text")
    return materialise(near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample).drop("h"), "langid")


def _landmarks(taken: DataFrame, n_languages: int, landmarks: int) -> np.ndarray:
    """The landmarks' presence rows, divided by their norms: of each language as many as MOST_LANDMARKS allows, at least one of the first languages."""
    per = max(1, min(landmarks, MOST_LANDMARKS // max(1, n_languages)))
    marks = taken.where(F.col("k") <= per).orderBy("k", "lang", "text").limit(MOST_LANDMARKS)

    def bits(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = [np.packbits(presence(*_joined([e]))[0] > 0).tobytes() for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()) for e in _examples(t)[k % 4 : k % 4 + 1] or _examples(t)[:1]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["bits"])

    rows = [np.unpackbits(np.frombuffer(r["bits"], np.uint8))[:WIDTH] for r in marks.mapInArrow(lean(bits), "bits binary").collect()]
    if not rows:
        return np.zeros((0, WIDTH), np.float32)
    z = np.unique(np.array(rows, np.uint8), axis=0).astype(np.float32)
    return z / np.sqrt(np.maximum(z.sum(axis=1, keepdims=True), 1))


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Learn from docs, of each language at most ``sample`` documents."""
    first = made()
    try:
        return _fit(docs, doc_id, text, lang, sample, landmarks, ridge)
    finally:
        remove_made(docs.sparkSession, first, made())


def _fit(docs: DataFrame, doc_id: str, text: str, lang: str, sample: int, landmarks: int, ridge: float) -> Model:
    taken = sampled(docs, doc_id=doc_id, text=text, lang=lang, sample=sample)
    counted = {r["lang"]: r["n"] for r in taken.groupBy("lang").agg(F.sum(_n_examples(F.col("text"))).alias("n")).collect()}
    languages = sorted(counted)
    z = _landmarks(taken, len(languages), landmarks)
    if not len(z):
        return Model([], z, np.zeros((0, 0), np.float32))
    n, m = sum(counted.values()), len(z)
    weight = {name: n / len(languages) / k for name, k in counted.items()}
    sent = docs.sparkSession.sparkContext.broadcast((z, weight))

    def sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's part of Knm' W Knm in blocks of rows (lang null), and of each language's sum of W Knm."""
        marks, weights = sent.value
        left, right = np.zeros((m, m)), {}
        for batch in parts:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = kernel(np.concatenate([x for _, x in batches(*_joined(_examples(t)))]), marks).astype(np.float64)
                left += weights[name] * (k.T @ k)
                right[name] = right.get(name, 0) + weights[name] * k.sum(axis=0)
        rows = [(i, None, left[i : i + SUMMED].tobytes()) for i in range(0, m, SUMMED)] + [(-1, name, v.tobytes()) for name, v in right.items()]
        for block, name, body in rows:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([name], pa.string()), pa.array([body], pa.binary())], ["block", "lang", "body"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in parts:
            for block, name, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                total[block, name] = total.get((block, name), 0) + np.frombuffer(body, float)
        for (block, name), v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([name], pa.string()), pa.array([v.tobytes()], pa.binary())], ["block", "lang", "body"])

    schema = "block int, lang string, body binary"
    found = taken.repartition(8).mapInArrow(lean(sums), schema).repartition(8, "block", "lang").sortWithinPartitions("block", "lang", "body").mapInArrow(lean(add), schema).collect()
    left = np.concatenate([np.frombuffer(r["body"], float).reshape(-1, m) for r in sorted((r for r in found if r["lang"] is None), key=lambda r: r["block"])])
    of = {r["lang"]: np.frombuffer(r["body"], float) for r in found if r["lang"] is not None}
    own = np.array([of[name] for name in languages]).T
    y = 2 * own - own.sum(axis=1, keepdims=True)  # 1 for the language's examples, -1 for the others
    left = left + ridge * n * (z @ z.T).astype(np.float64) + 1e-6 * np.eye(m)
    return Model(languages, z, np.linalg.solve(left, y).astype(np.float32))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def annotate(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """row (all columns of docs, as a struct), lang_pred and score."""
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("t"), lettered(F.col(text)).alias("ok"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = sent.value
        names = np.array([*learnt.languages, UNKNOWN], object)
        for batch in parts:
            n = batch.num_rows
            best, score = np.full(n, len(names) - 1), np.zeros(n)
            if learnt.languages and n:
                for low, matrix in batches(*utf8(batch.column(1))):
                    v = learnt.values(matrix)
                    e = np.exp(SHARP * (v - v.max(axis=1, keepdims=True)))
                    best[low : low + len(v)] = v.argmax(axis=1)
                    score[low : low + len(v)] = 1 / e.sum(axis=1)
                no = ~np.array(batch.column(2).to_pylist(), bool)
                best[no], score[no] = len(names) - 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(lean(run), schema)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that is kept from learning."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document, learnt from those that are not held out."""
    model = fit(docs.where(~held_out(F.col(doc_id))), doc_id=doc_id, text=text, lang=lang)
    out = annotate(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return out.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
