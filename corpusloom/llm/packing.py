"""Mixture-controlled packing: deficit round-robin over source queues.

The documents of a source, in ascending order of doc_id, are its queue of ids. Every window of ``length`` ids is
filled by rounds over the sources: a source's deficit grows by its target share of the window, it is served whole
ids while its deficit is at least ``least`` ids, and what is left of the deficit is carried to the next window. Room
that then remains goes to the sources that are owed most. Only the last window of all is padded.

Windows are dealt to partitions of equal numbers of windows. How many ids of each source stand before a place is a
function of the place and the targets alone (``Shares``: the exact shares, and whole numbers near them that always add up and never
fall), so a partition's first deficits are carried from the one before without running it, and any task computes the rounds of a partition
by itself, with each window's own shares: a source that runs out inside a partition changes the mixture there. Driver and
tasks hold a few numbers a source, and none a partition. So ids are placed where they are, and never shuffled: the only exchange is that of the texts by ranges of doc_id.

Targets: by default the sources' own shares of all ids, so that they end together; given ``targets`` (source to
weight) hold until a source runs out, and the others' weights are scaled up from there. Sources of no weight come last, in
proportion to their sizes.

Nulls: a null text is empty (its end id is all it has), a null source or doc_id is a value of its own, first in order.
Repeated ids are kept, ordered by text. A text of any length is cut into as many pieces as it needs. An empty table gives no
pieces. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import lean, materialise, parts_for, ragged, utf8
from .tokenfile import crcs, ended
from .tokens import encoder

LENGTH = 2048
LEAST = 256
#: Windows of a partition.
WINDOWS = 256
#: Rows of (file, source) offsets that are broadcast; beyond, they are joined by a shuffle.
SENT_ROWS = 300_000


def tokenised(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", end_id: int = 1, tokenizer: str | None = None, plain: bool = False) -> DataFrame:
    """A table of part, source, doc_id, first (place in the part's queue of the source), n, ids (bytes)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(parts_for(docs.select(doc_id, source, text)), F.col("doc_id")).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, bpe, ahead = TaskContext.get().partitionId(), encoder(tokenizer, plain=plain), {}
        for batch in batches:
            sources = batch.column(1).to_pylist()
            for low, ids, counts in bpe.encode_column(batch.column(2)):
                ids, n = ended(ids, counts, end_id)
                firsts = []
                for s, k in zip(sources[low : low + len(n)], n.tolist(), strict=True):
                    firsts.append(ahead.get(s, 0))
                    ahead[s] = firsts[-1] + k
                at = np.concatenate([[0], np.cumsum(n) * ids.dtype.itemsize]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(n), part, np.int32)), batch.column(1).slice(low, len(n)), batch.column(0).slice(low, len(n)),
                        pa.array(firsts, pa.int64()), pa.array(n, pa.int64()),
                        pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(ids.tobytes())]),
                    ],
                    ["part", "source", "doc_id", "first", "n", "ids"],
                )

    return materialise(rows.mapInArrow(lean(run), "part int, source string, doc_id long, first long, n long, ids binary"), "packing")


class Shares:
    """How many ids of each source stand before any place of the packed stream.

    The stream has phases: one ends where a source runs out. In a phase the sources that are left get whole numbers of ids
    (``amounts``), dealt evenly along it: the sources are the leaves of a binary tree (Huffman's, so that large ones are near the
    root), and of n ids at a node the lighter child gets its rounded share and the other the rest. Both grow with n, so
    counts never fall, add up to the place, and are near the exact shares, whichever place is asked for. Sources of no weight are the last phase.
    Phases are functions of the time when they end, so only a few numbers a source are held, and the tree of the phase that was asked for last."""

    def __init__(self, totals: np.ndarray, weights: np.ndarray):
        self.totals, self.heavy = totals, (weights > 0) & (totals > 0)
        self.weights = np.where(self.heavy, weights, 0.0)
        # A source of weight w runs out at time total / w.
        self.time = np.where(self.heavy, totals / np.where(self.heavy, weights, 1.0), np.inf)
        self.times = np.unique(self.time[self.heavy])
        self._phase: tuple = (0, 0, None, None)  # first place, last place, ids of each source before it, amounts
        self._tree: tuple = (None, None)
        self._kept: dict[int, np.ndarray] = {}

    def _until(self, k: int) -> np.ndarray:
        """Ids of each source up to the end of phase k."""
        if k < 0:
            return np.zeros(len(self.totals), np.int64)
        if k >= len(self.times):
            return self.totals
        then = np.where(self.time <= self.times[k], self.totals, np.minimum(self.totals, np.floor(self.weights * self.times[k])))
        return np.where(self.heavy, then, 0).astype(np.int64)

    def _at(self, place: int) -> tuple:
        """The phase of a place after 0."""
        if not self._phase[0] < place <= self._phase[1]:
            k = bisect_left(range(len(self.times)), place, key=lambda k: int(self._until(k).sum()))
            done, then = self._until(k - 1), self._until(k)
            self._phase = (int(done.sum()), int(then.sum()), done, then - done)
        return self._phase

    def exact(self, place: int) -> np.ndarray:
        if not place:
            return np.zeros(len(self.totals))
        first, last, done, amounts = self._at(place)
        return done + amounts * ((place - first) / (last - first))

    def whole(self, place: int) -> np.ndarray:
        if place not in self._kept:
            if len(self._kept) >= 64:
                self._kept.clear()
            self._kept[place] = self._whole(place)
        return self._kept[place]

    def _whole(self, place: int) -> np.ndarray:
        if not place:
            return np.zeros(len(self.totals), np.int64)
        first, _, done, amounts = self._at(place)
        if self._tree[0] is not self._phase:
            self._tree = (self._phase, _tree(amounts))
        steps, out = self._tree[1], done.copy()
        if not steps:  # one source
            out[np.flatnonzero(amounts)] += place - first
        count = {len(steps): place - first}
        for node in range(len(steps) - 1, -1, -1):
            light, heavy, share = steps[node]
            n = count.pop(node + 1)
            part = int(n * share + 0.5)
            for child, k in ((light, part), (heavy, n - part)):
                if child < 0:
                    out[~child] += k
                else:
                    count[child + 1] = k
        return out

    def before(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        """(exact shares, whole ids) of all sources before the place."""
        return self.exact(place), self.whole(place)

    def of(self, source: int, place: int) -> int:
        """Whole ids of a source before the place."""
        return int(self.whole(place)[source])

    def holding(self, source: int, k: int, per: int) -> int:
        """Which run of ``per`` places has the source's id k (from 0)."""
        total = int(self.totals.sum())
        if self.heavy[source]:
            near = np.minimum(self.totals, self.weights * (k / self.weights[source])).sum()
        else:
            rest = self.totals[~self.heavy].sum()
            near = total - rest + rest * (k / self.totals[source])
        p = max(0, min(int(near), total - 1)) // per
        while p and self.of(source, p * per) > k:
            p -= 1
        while self.of(source, min((p + 1) * per, total)) <= k:
            p += 1
        return p


def _tree(amounts: np.ndarray) -> list[tuple[int, int, float]]:
    """Nodes, the root last: lighter child, other child, the lighter one's share; leaves are ~source."""
    heap = [(int(amounts[i]), ~i) for i in np.flatnonzero(amounts).tolist()]
    heapify(heap)
    nodes: list[tuple[int, int, float]] = []
    while len(heap) > 1:
        (a, light), (b, heavy) = heappop(heap), heappop(heap)
        nodes.append((light, heavy, a / (a + b)))
        heappush(heap, (a + b, len(nodes) - 1))
    return nodes


def quotas(totals: np.ndarray, weights: np.ndarray, per: int) -> tuple[np.ndarray, np.ndarray]:
    """(exact shares, whole ids) of each source before each partition of ``per`` ids and after the last: for a look at a small mixture."""
    shares, total = Shares(totals, weights), int(totals.sum())
    found = [shares.before(min(p * per, total)) for p in range(-(-total // per) + 1)]
    return np.array([x for x, _ in found]), np.array([x for _, x in found])


def rounds(p: int, shares: Shares, windows: int, length: int, least: int) -> dict[int, tuple[np.ndarray, ...]]:
    """Of each source that partition p serves: places in its queue, windows and offsets of its pieces."""
    total, n = int(shares.totals.sum()), len(shares.totals)
    first, end = p * windows * length, min((p + 1) * windows * length, total)
    at, stop = shares.whole(first).copy(), shares.whole(end)
    owed = shares.exact(first)
    deficit = owed - at
    small = min(least, length)
    pieces: dict[int, list[tuple[int, int, int]]] = {}
    for w, low in enumerate(range(first, end, length), p * windows):
        room, offset = min(length, end - low), 0
        then = shares.exact(low + room)
        deficit += then - owed
        owed = then

        def serve(i: int, k: int) -> None:
            nonlocal offset, room
            have, here = pieces.setdefault(i, []), int(at[i])
            if not (have and have[-1][1] == w and have[-1][2] + here - have[-1][0] == offset):  # else it goes on where the last piece ends
                have.append((here, w, offset))
            at[i] += k
            offset += k
            room -= k
            deficit[i] -= k

        ready = np.flatnonzero((deficit >= small) & (stop - at >= small))
        for i in ready[np.argsort((ready - w) % n, kind="stable")].tolist():
            k = min(room, int(stop[i] - at[i]), int(deficit[i]))
            if k >= small:
                serve(i, k)
        left = np.where(at < stop, deficit, -np.inf) if room else deficit
        while room:
            i = int(left.argmax())
            serve(i, min(room, int(stop[i] - at[i]), max(least, int(deficit[i]))))
            left[i] = deficit[i] if at[i] < stop[i] else -np.inf
    return {i: tuple(np.array([x[c] for x in have], np.int64) for c in range(3)) for i, have in pieces.items()}


def pack(docs: DataFrame, *, length: int = LENGTH, least: int = LEAST, targets: dict[str, float] | None = None, end_id: int = 1, **options) -> DataFrame:
    """doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    spark = docs.sparkSession
    table = tokenised(docs, end_id=end_id, **options)
    each = table.groupBy("part", "source").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = materialise(each.select("part", "source", "n", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")), "packing-offsets")
    totals = {r["source"]: r["n"] for r in each.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals, key=lambda s: (s is not None, s or ""))
    count = np.array([totals[s] for s in names], np.int64)
    weights = count.astype(float) if targets is None else np.array([float(targets.get(s, 0.0)) for s in names])
    windows = WINDOWS
    sent = spark.sparkContext.broadcast((names, Shares(count, weights)))
    few = each.count() <= SENT_ROWS
    offsets = each.select("part", F.col("source").alias("s"), "base")
    joined = table.join(F.broadcast(offsets) if few else offsets, (table["part"] == offsets["part"]) & table["source"].eqNullSafe(offsets["s"]))
    rows = joined.select(table["doc_id"], table["source"], (F.col("base") + F.col("first")).alias("at"), F.col("n"), F.col("ids"), table["part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, shares = sent.value
        place = {s: i for i, s in enumerate(names)}

        @lru_cache(maxsize=64)
        def of(p: int):
            return rounds(p, shares, windows, length, least)

        @lru_cache(maxsize=1024)
        def holding(s: int, place: int) -> int:
            """The partition in which a place of a source's queue is."""
            return shares.holding(s, place, windows * length)

        for batch in batches:
            low = 0
            sizes, parts = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sums = np.concatenate([[0], np.cumsum(sizes)])
            # A task may read several parts' files, in any order: rows of two parts can be any number of windows apart.
            for end in [*(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(sizes)]:
                while low < end:
                    high = min(end, max(low + 1, int(np.searchsorted(sums, sums[low] + (1 << 19), "right")) - 1))
                    yield from _pieces(batch.slice(low, high - low), place, holding, of)
                    low = high

    schema = T.StructType.fromDDL("doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return rows.mapInArrow(lean(run), schema)


def _pieces(batch: pa.RecordBatch, place: dict, holding, of) -> Iterator[pa.RecordBatch]:
    sources = np.array([place[s] for s in batch.column(1).to_pylist()], np.int64)
    at, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
    blob = batch.column(4)
    raw, edges = utf8(blob)
    size = (int(edges[-1]) // max(1, int(n.sum()))) or 2
    ids = np.frombuffer(raw.tobytes(), f"<u{size}")
    firsts = np.concatenate([[0], np.cumsum(n)])
    doc, start, stop, window, offset = ([] for _ in range(5))
    for s in np.unique(sources).tolist():
        rows = np.flatnonzero(sources == s)
        a, b = at[rows], at[rows] + n[rows]
        parts = [x for x in (of(q).get(s) for q in range(holding(s, int(a.min())), holding(s, int(b.max()) - 1) + 1)) if x is not None]
        q, w, o = (np.concatenate([x[c] for x in parts]) for c in range(3))
        ends = np.append(q[1:], np.iinfo(np.int64).max)
        i = np.searchsorted(q, a, "right") - 1
        j = np.searchsorted(q, b, "left")
        many = j - i
        k, d = ragged(i, many), np.repeat(np.arange(len(rows)), many)
        x, y = np.maximum(q[k], a[d]), np.minimum(ends[k], b[d])
        doc.append(rows[d])
        start.append(x - a[d])
        stop.append(y - a[d])
        window.append(w[k])
        offset.append(o[k] + x - q[k])
    doc, start, stop, window, offset = map(np.concatenate, (doc, start, stop, window, offset))
    order = np.lexsort((start, doc))
    doc, start, stop, window, offset = (v[order] for v in (doc, start, stop, window, offset))
    # The pieces of a batch, in order, are its ids, in order.
    crc = crcs(ids, np.append(firsts[doc] + start, firsts[-1]))
    yield pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), pa.array(start), pa.array(stop - start),
            pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(window), pa.array(offset),
        ],
        ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    )
