"""Byte-level BPE by ranks: encoding and decoding with a segment tree over byte positions.

Each match of the splitting pattern is a piece. A piece whose bytes are a token is that token; any other starts as its bytes, and the
neighbours of least rank, the leftmost of equal ones, are merged until no neighbours are a token. A segment tree has a leaf for
each byte position with the key (rank of the token that starts here joined with the next live one, position) and keeps minima, so
its root is the leftmost pair of least rank. A merge sets three leaves, those of the pair and of the live neighbour before it, and renews the paths above them.

Pieces are encoded once for a block of text and kept in a table of at most KEPT pieces in each worker. New pieces of one width are encoded
together, their trees as the rows of a matrix; a few wide ones have trees of their own. Documents are independent rows, so nothing is shuffled.

Nulls and empty texts have no ids and decode to no bytes; a null doc_id is carried along; repeated rows are encoded each. A text of any
length is split in stretches of WINDOW characters, ended where the pattern cannot join what is before and after. Ties of rank
go to the left. An empty table gives no rows. Other columns are ignored, whatever their names. An id that no token has makes decoding fail.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, ragged

NAME = "byte_bpe_50k.tiktoken"
#: Pieces that a worker keeps.
KEPT = 1_000_000
#: Characters that are split at once, and bytes of text after which rows are handed on.
WINDOW, BLOCK = 1 << 20, 1 << 20
#: From so many pieces of one width on, their trees are stacked; and the cells of a stack.
STACKED, CELLS = 24, 1 << 20
_NONE = np.int64(1) << np.int64(62)


class Ranks:
    """A vocabulary: tokens by rank, and the rank of each pair of tokens that joins to a token."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        import public_tokenizers
        import regex

        with open(path or public_tokenizers.path(NAME), "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(pattern or public_tokenizers.PATTERN)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        get, pairs = self.rank.get, {}
        for token, rank in self.rank.items():
            for k in range(1, len(token)):
                left, right = get(token[:k]), get(token[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        # The tokens' bytes, one after the other; ranks without a token have a length below 0.
        self.lengths = np.full(max(self.rank.values()) + 1, -1, np.int64)
        by_rank = sorted((r, t) for t, r in self.rank.items())
        self.lengths[[r for r, _ in by_rank]] = [len(t) for _, t in by_rank]
        self.starts = np.cumsum(np.maximum(self.lengths, 0)) - np.maximum(self.lengths, 0)
        self.raw = np.frombuffer(b"".join(t for _, t in by_rank), np.uint8)
        self.kept: dict[str, bytes] = {}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair joined, _NONE where that is no token."""
        wanted = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.joined[at], _NONE)

    def split(self, text: str) -> list[str]:
        """The pattern's matches."""
        if len(text) <= WINDOW:
            return self.pattern.findall(text)
        out, low = [], 0
        while low < len(text):
            high = text.find(" ", low + WINDOW)
            while 0 <= high < len(text) - 1 and text[high + 1].isspace():
                high = text.find(" ", high + 1)
            # A space before a non-blank always begins a piece.
            high = high if 0 <= high < len(text) - 1 else len(text)
            out += self.pattern.findall(text, low, high)
            low = high
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.split(t) for t in texts]
        kept = self.kept
        new = [p for p in set().union(*pieces) if p not in kept]
        if len(kept) + len(new) > KEPT:
            kept.clear()
            new = list(set().union(*pieces))
        kept.update(zip(new, self.merge([p.encode() for p in new]), strict=True))
        get = kept.__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece."""
        out: list[bytes | None] = [None] * len(pieces)
        widths: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.rank.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            else:
                widths.setdefault(max(1, (len(piece) - 1).bit_length()), []).append(i)
        for bits, group in widths.items():
            if len(group) < STACKED or 1 << bits > CELLS // STACKED:
                for i in group:
                    out[i] = self.tree(pieces[i])
                continue
            step = CELLS >> bits
            for low in range(0, len(group), step):
                some = group[low : low + step]
                for i, ids in zip(some, self.trees([pieces[i] for i in some], bits), strict=True):
                    out[i] = ids
        return out

    def tree(self, piece: bytes) -> bytes:
        """The ids of one piece, its tree a list: node i is above nodes 2i and 2i + 1."""
        n, get = len(piece), self.pairs.get
        bits = max(1, (n - 1).bit_length())
        width, none, mask = 1 << bits, 1 << 62, (1 << bits) - 1
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                tree[width + i] = rank << bits | i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def put(i: int, key: int) -> None:
            i += width
            tree[i] = key
            while i > 1:
                i >>= 1
                key = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == key:
                    break
                tree[i] = key

        def key(i: int, j: int) -> int:
            rank = get(ids[i] << 32 | ids[j])
            return none if rank is None else rank << bits | i

        while tree[1] != none:
            i = tree[1] & mask
            j = after[i]
            ids[i], alive[j], after[i] = tree[1] >> bits, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            put(j, none)
            put(i, key(i, after[i]) if after[i] < n else none)
            if before[i] >= 0:
                put(before[i], key(before[i], i))
        return np.array(ids, "<u4")[np.array(alive)].tobytes()

    def trees(self, pieces: list[bytes], bits: int) -> list[bytes]:
        """The ids of pieces of at most 1 << bits bytes: a row of each matrix is a piece, and a round merges one pair of each row."""
        width, count = 1 << bits, len(pieces)
        n = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(count, width)
        column = np.arange(width)
        alive = column < n[:, None]
        ids = self.byte[raw]
        tree = np.full((count, 2 * width), _NONE, np.int64)
        rank = np.where(alive[:, 1:], self.ranks_of(ids[:, :-1], ids[:, 1:]), _NONE)
        tree[:, width:-1] = np.where(rank == _NONE, _NONE, rank << bits | column[:-1])
        for level in range(bits - 1, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        after = np.minimum(np.tile(column + 1, (count, 1)), n[:, None])
        before = np.tile(np.append(column, width) - 1, (count, 1))  # the last cell takes what nobody reads

        def keys(r: np.ndarray, i: np.ndarray, j: np.ndarray, there: np.ndarray) -> np.ndarray:
            rank = np.where(there, self.ranks_of(ids[r, np.where(there, i, 0)], ids[r, np.where(there, j, 0)]), _NONE)
            return np.where(rank == _NONE, _NONE, rank << bits | i)

        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            i = tree[rows, 1] & (width - 1)
            j, h = after[rows, i], before[rows, i]
            k = after[rows, j]
            ids[rows, i] = tree[rows, 1] >> bits
            alive[rows, j], after[rows, i] = False, k
            before[rows, np.where(k < n[rows], k, width)] = i
            tree[rows, width + j] = _NONE
            tree[rows, width + i] = keys(rows, i, k, k < n[rows])
            left = h >= 0
            tree[rows[left], width + h[left]] = keys(rows[left], h[left], i[left], np.ones(int(left.sum()), bool))
            node = width + np.concatenate([i, j, np.where(left, h, i)])
            r = np.tile(rows, 3)
            for _ in range(bits):
                node >>= 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            rows = rows[tree[rows, 1] < _NONE]
        flat, ends = ids[alive].astype("<u4").tobytes(), np.cumsum(alive.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        if len(n) and n.min() < 0:
            raise ValueError("an id without a token")
        return self.raw[ragged(self.starts[ids], n)].tobytes()


_ranks: dict[tuple, Ranks] = {}


def ranks(path: str | None = None, pattern: str | None = None) -> Ranks:
    """This process's vocabulary."""
    if (path, pattern) not in _ranks:
        _ranks[path, pattern] = Ranks(path, pattern)
    return _ranks[path, pattern]


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows low .. high-1 of about BLOCK bytes each, one at least."""
    sums, low = np.concatenate([[0], np.cumsum(sizes)]), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(sums, sums[low] + BLOCK, "right")) - 1)
        yield low, high
        low = high


def encode(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) of each document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ranks(path, pattern)
        for batch in batches:
            for low, high in _runs(pc.binary_length(batch.column(1)).to_numpy()):
                ids = vocabulary.encode(batch.column(1).slice(low, high - low).to_pylist())
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), n, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, *, ids: str = "ids", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids and the bytes that the ids stand for, ``decoded``. Null ids are none."""
    rows = encoded.select("doc_id", "n_tokens", F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ranks(path)
        for batch in batches:
            for low, high in _runs(pc.binary_length(batch.column(2)).to_numpy()):
                part = batch.slice(low, high - low)
                data = pa.array([vocabulary.decode(np.frombuffer(x, "<u4")) for x in part.column(2).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, data], ["doc_id", "n_tokens", "ids", "decoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, ids binary, decoded binary")
