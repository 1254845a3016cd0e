"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of documents in ascending order of id, each document ended by an end id::

    MAGIC | blocks | block starts u64[nb + 1] | document ids i64[nd] | first ids u64[nd + 1] | footer

The footer says, besides the numbers of blocks, documents and ids, how many of the first documents have no id.

A block has BLOCK ids (the last may have fewer): u32 least id, u8 width, u16 ids, u16 exceptions, then
``id - least`` packed in ``width`` low bits each, then u16 places and u32 high bits of the exceptions. The width is
that of the block's PERCENTILE-th widest difference. The index of block starts finds any document without reading
what stands before it.

``write`` deals documents by ranges of doc_id, a file to a range, and returns a line per file; files are named by
attempt, so a task that runs again leaves no half-written file behind in the list. ``read`` gives each document
back. Nulls: a null text is empty (its end id is all it has); a null doc_id comes first and is kept. Repeated ids
are kept, ordered by text. A text of any length is encoded as a whole, ids of 2 bytes each in memory. No documents, no files.
Other columns are ignored. Control strings in a text: see ``tokens``.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, lean, parts_for, small_batches
from .tokens import encoder

MAGIC = b"CLPFOR02"
BLOCK = 1024
PERCENTILE = 0.95
_HEAD = struct.Struct("<IBHH")
_FOOT = struct.Struct("<QQQQQ8s")
#: Bits of each 16-bit value.
_BITS = np.array([v.bit_length() for v in range(1 << 16)], np.uint8)


def _widths(rel: np.ndarray) -> np.ndarray:
    if rel.dtype == np.uint16:
        return _BITS[rel]
    high = (rel >> np.uint32(16)).astype(np.uint16)
    return np.where(high > 0, _BITS[high] + 16, _BITS[(rel & np.uint32(0xFFFF)).astype(np.uint16)]).astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values as rows of bytes, ``width`` bits a value, high bit first."""
    bits = 8 * values.dtype.itemsize
    flat = values.astype(values.dtype.newbyteorder(">")).view(np.uint8)
    return np.packbits(np.unpackbits(flat).reshape(len(values), -1, bits)[:, :, bits - width :].reshape(len(values), -1), axis=1)


def _unpack(packed: np.ndarray, width: int, n: int, dtype: np.dtype) -> np.ndarray:
    bits = 8 * dtype.itemsize
    out = np.zeros((len(packed), n, bits), np.uint8)
    out[:, :, bits - width :] = np.unpackbits(packed, axis=1)[:, : n * width].reshape(len(packed), n, width)
    return np.packbits(out.reshape(len(packed), -1), axis=1).view(dtype.newbyteorder(">")).astype(dtype)


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """The blocks of ids (unsigned, 2 or 4 bytes)."""
    if not len(ids):
        return []
    n = -(-len(ids) // BLOCK)
    last = len(ids) - (n - 1) * BLOCK
    rows = np.concatenate([ids, np.full(n * BLOCK - len(ids), ids[-1], ids.dtype)]).reshape(n, BLOCK)
    least = rows.min(axis=1)
    rel = rows - least[:, None]
    widths = _widths(rel)
    k = min(BLOCK - 1, int(percentile * BLOCK))
    chosen = np.partition(widths, k, axis=1)[:, k]
    high = rel >> chosen[:, None].astype(rel.dtype)
    block, place = np.nonzero(high)
    keep = (block < n - 1) | (place < last)
    block, place = block[keep], place[keep]
    over = high[block, place].astype("<u4")
    edges = np.searchsorted(block, np.arange(n + 1))
    packed: list[bytes] = [b""] * n
    for width in np.unique(chosen).tolist():
        if width:
            which = np.flatnonzero(chosen == width)
            low = rel[which] & rel.dtype.type((1 << width) - 1)
            for i, row in zip(which.tolist(), _pack(low, width), strict=True):
                packed[i] = row.tobytes()
    place = place.astype("<u2")
    out = []
    for i in range(n):
        a, b = int(edges[i]), int(edges[i + 1])
        size = BLOCK if i < n - 1 else last
        out.append(_HEAD.pack(int(least[i]), int(chosen[i]), size, b - a) + packed[i] + place[a:b].tobytes() + over[a:b].tobytes())
    return out


def unpack_blocks(data: bytes, starts: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """The ids of blocks that begin at starts (the last entry: where they end) of data."""
    n = len(starts) - 1
    heads = [_HEAD.unpack_from(data, int(s)) for s in starts[:-1]]
    out = np.zeros((n, BLOCK), dtype)
    widths = np.array([h[1] for h in heads], np.int64)
    for width in np.unique(widths).tolist():
        if width:
            which = np.flatnonzero(widths == width)
            size = BLOCK * width // 8
            raw = b"".join(data[int(starts[i]) + _HEAD.size : int(starts[i]) + _HEAD.size + size] for i in which)
            out[which] = _unpack(np.frombuffer(raw, np.uint8).reshape(len(which), size), width, BLOCK, dtype)
    for i, (_, width, _, exceptions) in enumerate(heads):
        if exceptions:
            at = int(starts[i]) + _HEAD.size + BLOCK * width // 8
            place = np.frombuffer(data, "<u2", exceptions, at)
            out[i, place] |= (np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions) << np.uint32(width)).astype(dtype)
    out += np.array([h[0] for h in heads], dtype)[:, None]
    total = sum(h[2] for h in heads)
    return out.reshape(-1)[:total]


class Writer:
    """A file of documents, written as they come."""

    def __init__(self, stream, dtype: np.dtype, percentile: float = PERCENTILE):
        self.stream, self.dtype, self.percentile = stream, dtype, percentile
        self.stream.write(MAGIC + bytes([dtype.itemsize]) + bytes(7))
        self.at, self.starts, self.docs, self.counts = 16, [16], [], []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_null = 0

    def _flush(self, ids: np.ndarray) -> None:
        for block in pack_blocks(ids, self.percentile):
            self.stream.write(block)
            self.at += len(block)
            self.starts.append(self.at)

    def add(self, docs: np.ndarray, counts: np.ndarray, ids: np.ndarray, n_null: int = 0) -> None:
        """Documents of ascending ids; the first ``n_null`` have none (whatever docs says)."""
        self.docs.append(docs)
        self.n_null += n_null
        self.counts.append(counts)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 512 * BLOCK:
            every = np.concatenate(self.held)
            full = len(every) // BLOCK * BLOCK
            self._flush(every[:full])
            self.held, self.n_held = [every[full:]], len(every) - full

    def close(self) -> tuple[int, int]:
        """Numbers of documents and ids."""
        if self.n_held:
            self._flush(np.concatenate(self.held))
        docs = np.concatenate([*self.docs, np.zeros(0, np.int64)]).astype("<i8")
        firsts = np.concatenate([[0], np.cumsum(np.concatenate([*self.counts, np.zeros(0, np.int64)]))]).astype("<u8")
        index = np.array(self.starts, "<u8").tobytes()
        self.stream.write(index + docs.tobytes() + firsts.tobytes() + _FOOT.pack(self.at, len(self.starts) - 1, len(docs), int(firsts[-1]), self.n_null, MAGIC))
        self.stream.close()
        return len(docs), int(firsts[-1])


class Reader:
    """Random access to a file's documents."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        at, nb, nd, self.n_ids, self.n_null, magic = _FOOT.unpack(stream.read_at(_FOOT.size, size - _FOOT.size))
        head = stream.read_at(16, 0)
        if magic != MAGIC or head[:8] != MAGIC:
            raise ValueError("not a token file")
        self.dtype = np.dtype(f"<u{head[8]}")
        index = stream.read_at(8 * (nb + 1 + nd + nd + 1), at)
        self.starts = np.frombuffer(index, "<u8", nb + 1).astype(np.int64)
        self.docs = np.frombuffer(index, "<i8", nd, 8 * (nb + 1))
        self.firsts = np.frombuffer(index, "<u8", nd + 1, 8 * (nb + 1 + nd)).astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids from first to before last, by the index of block starts."""
        if last <= first:
            return np.zeros(0, self.dtype)
        a, b = first // BLOCK, (last - 1) // BLOCK
        low, high = int(self.starts[a]), int(self.starts[b + 1])
        data = self.stream.read_at(high - low, low)
        return unpack_blocks(data, self.starts[a : b + 2] - low, self.dtype)[first - a * BLOCK : last - a * BLOCK]

    def runs(self, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, document after the last, their ids) for runs of about ``most`` ids."""
        i, n = 0, len(self.docs)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.firsts, self.firsts[i] + most, "right")) - 1)
            yield i, j, self.ids(int(self.firsts[i]), int(self.firsts[j]))
            i = j


def ended(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """ids with end_id after each text's ids."""
    return np.insert(ids, np.cumsum(counts), ids.dtype.type(end_id)), counts + 1


def crcs(ids: np.ndarray, edges: np.ndarray) -> list[int]:
    """crc32 of ids[edges[i]:edges[i+1]] as little-endian unsigned 32-bit integers."""
    raw = memoryview(ids.astype("<u4").tobytes())
    at = (4 * edges).tolist()
    return [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])]


def write(docs: DataFrame, to: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 2, tokenizer: str | None = None, plain: bool = False) -> list[tuple[str, int, int]]:
    """(path, documents, ids) of each file, in ascending order of doc_id."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(parts_for(docs.select(doc_id, text)), F.col("doc_id")).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(to)
        store.create_dir(root, recursive=True)
        path, writer, bpe = f"{root}/{uuid.uuid4().hex}.pfor", None, encoder(tokenizer, plain=plain)
        for batch in batches:
            null, names = batch.column(0).is_null().to_numpy(zero_copy_only=False), batch.column(0).fill_null(0).to_numpy()
            for low, ids, counts in bpe.encode_column(batch.column(1)):
                writer = writer or Writer(store.open_output_stream(path, compression=None), bpe.dtype)
                ids, n = ended(ids, counts, end_id)
                writer.add(names[low : low + len(n)], n, ids, int(null[low : low + len(n)].sum()))
        if writer is not None:
            n_docs, n_ids = writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    with small_batches(docs.sparkSession):
        found = rows.mapInArrow(lean(run), "part int, path string, n_docs long, n_ids long").collect()
    return [(r["path"], r["n_docs"], r["n_ids"]) for r in sorted(found)]


def read(spark: SparkSession, files: list[tuple[str, int, int]], base: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, a file to a task; start counts over all files."""
    before, rows = 0, []
    for path, _, n in files:
        rows.append((path, before))
        before += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(base)[0]
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as stream:
                    reader = Reader(stream)
                    for i, j, ids in reader.runs():
                        edges = reader.firsts[i : j + 1]
                        names = reader.docs[i:j]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array(names, pa.int64(), mask=np.arange(i, j) < reader.n_null),
                            "start": pa.array(start + edges[:-1], pa.int64()),
                            "n_tokens": pa.array(np.diff(edges), pa.int64()),
                            "ids_crc32": pa.array(crcs(ids, edges - edges[0]), pa.int64()),
                        })

    listed = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return listed.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def store(docs: DataFrame, **options) -> DataFrame:
    """Write docs as token files in the shared folder and read them back."""
    to = fresh_path(docs.sparkSession, "tokens")
    return read(docs.sparkSession, write(docs, to, **options), to)
