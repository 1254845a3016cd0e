r"""N-gram Jaccard join with token-combination prefixes: components of documents whose shingle sets are alike.

Sets. Words are ``[^\x20\x09-\x0D]+`` after A-Z became a-z; a document's set holds its distinct ``WORDS``-word
shingles (with fewer words, the whole sequence), as 64-bit hashes. Documents of equal words in equal order (by a 128-bit
cryptographic digest) are one class from the start; what follows is about classes. Two link when
100 |x & y| >= PERCENT |x | y|; hashes find candidates, and every link is verified on the words themselves.

Tokens. Shingles are counted over all documents. Those of df >= 32 are frequent, those of df >= 1024 very frequent; the
table that is sent holds the TABLE most frequent ones (its bounded size is the only reason for one of higher df
to count as rare, which costs candidates and loses none). The order of tokens is rare, frequent, very frequent, then by hash.

Prefixes. With t = |x| - ceil(.9 |x|), a partner lacks at most t tokens of x. Tokens are taken in order until
sum over token classes of max(0, taken - k + 1) > t, where k is 1 for rare, 2 for frequent, 3 for very frequent tokens:
then at least k tokens of one class are shared by any partner, whose own prefix holds them too if it ends later (and
the other way round if it ends sooner). An entry's mark says from which t on it is in the prefix, so that two sets meet
on the prefixes that a link of just their sizes needs. So single rare tokens and all k-combinations of frequent ones are indexed.
Frequent classes are cut by hash into subclasses, more for larger sets, so that combinations stay few; a pair
meets on the level of the larger of its sizes. Sets so small that one shingle less is too little (under 9 at 90 %) link with
equal sets only and have one entry, a hash of the set.

Candidates. In STARS rounds each index entry that holds several components links one class with those of the other
components (a star: as many pairs as entries): the class that shares most with others, so the original of a group of
copies where there is one; components grow by what is verified. Then entries that still hold several components
give their pairs across components, dealt by bands of set size so that only sizes that can link meet. So a group of near
copies is not paired out, and no link between components is lost. Pairs are kept if their sizes and the number of prefix tokens they share allow a link, and are then verified on the
whole sets of both texts. Texts are fetched for classes in such pairs: a bitmap of fixed size of the documents asked
for is sent first, so that few others are moved.

Nulls: a null or empty text, or one without words, has no shingles and links with nothing; a null doc_id is carried
along and is no one's component unless it is alone. Repeated rows each give a row. A text's length is not bounded: it is read
in an Arrow batch, and its hashes are held one text at a time. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import lean, made, materialise, mix, parts_for, ragged, remove_made, segment_hashes, utf8

WORDS = 3
PERCENT = 90
#: Least df and combination size of the frequent classes.
CLASSES = ((32, 2), (1024, 3))
TABLE = 1 << 20
#: Bits of a shingle's hash by which it is counted; others of equal bits only make it look more frequent.
TOKEN_BITS = 40
STARS = 3
#: Ranges of tokens to a partition.
RANGES = 8
#: Bits of the bitmap of documents whose texts are asked for, 64 to a row.
BITMAP = 1 << 24
_BLOCK = 1 << 19
_TALLY = 1_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_NO_ID = -(1 << 63)
#: 1 for bytes of words, and masks of the first 0 to 8 bytes of a number.
_IN_WORD = bytes(b not in (0x20, *range(9, 14)) for b in range(256))
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, number of words of each). Words of 32 bytes or less are four numbers, which are mixed."""
    data = raw.tobytes().translate(_LOWER)
    raw, word = np.frombuffer(data, np.uint8), np.frombuffer(data.translate(_IN_WORD), bool)
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    full = at[1:] > at[:-1]
    begins[at[:-1][full]] = word[at[:-1][full]]
    stops[at[1:][full] - 1] = word[at[1:][full] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    n = ends - starts
    padded = np.concatenate([raw, np.zeros(40 - len(raw) % 8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint64), (len(raw) + 25,), (1,))  # the 8 bytes from each place
    lane = lambda k, which: eight[starts[which] + 8 * k] & _FIRST_BYTES[np.clip(n[which] - 8 * k, 0, 8)]
    h = mix(lane(0, slice(None)) ^ mix(lane(1, slice(None)) + n.astype(np.uint64) * _ODD[0]))
    wide = np.flatnonzero(n > 16)
    h[wide] = mix(mix(h[wide] ^ lane(2, wide)) + lane(3, wide) * _ODD[1])
    long = np.flatnonzero(n > 32)
    if len(long):
        stops = np.cumsum(n[long])
        h[long] ^= segment_hashes(raw[ragged(starts[long], n[long])], stops - n[long], stops, strong=True)
    return h, np.diff(np.searchsorted(starts, at))


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, at = utf8(column)
    low = 0
    while low < len(at) - 1:
        high = max(low + 1, int(np.searchsorted(at, at[low] + _BLOCK, "right")) - 1)
        h, counts = word_hashes(raw[at[low] : at[high]], at[low : high + 1] - at[low])
        edges = np.concatenate([[0], np.cumsum(counts)])
        n = max(0, len(h) - words + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(words):
            rolled += h[k : k + n] * _ODD[k % len(_ODD)] * np.uint64(2 * (k // len(_ODD)) + 1)
        rolled = mix(rolled)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a >= words:
                s = np.sort(rolled[a : b - words + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for k in range(a, b):
                    whole = mix(whole * _ODD[0] + h[k : k + 1])
                yield whole
            else:
                yield np.zeros(0, np.uint64)
        low = high


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()  # at 0x20 and 0x09 to 0x0D, as Python splits bytes


def digest(text: bytes) -> bytes:
    """Of the words of a text, in order; empty where there are none."""
    words = words_of(text)
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else b""


def shingles_of(text: bytes, words: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    w = words_of(text)
    return {*zip(*(w[k:] for k in range(words)))} if len(w) >= words else {tuple(w)} if w else set()


def set_number(s: np.ndarray) -> int:
    """A 64-bit number of a set; equal sets, equal numbers."""
    if not len(s):
        return 0
    return int(mix(s.sum(dtype=np.uint64, keepdims=True) * _ODD[1] + np.uint64(len(s))).view(np.int64)[0])


# Counting: each task's tokens, TOKEN_BITS bits of each, sorted and written as differences, in packets by range.


def _packets(tokens: np.ndarray, n_parts: int) -> Iterator[tuple[int, bytes]]:
    tokens, counts = np.unique(tokens >> np.uint64(64 - TOKEN_BITS), return_counts=True)
    width = -(-(1 << TOKEN_BITS) // n_parts)
    edges = np.searchsorted(tokens, (np.arange(n_parts + 1, dtype=np.float64) * width).astype(np.uint64))
    for p in range(n_parts):
        t, c = tokens[edges[p] : edges[p + 1]], counts[edges[p] : edges[p + 1]]
        if len(t):
            delta = np.diff(t)
            size = next(b for b in (3, 4, 8) if b == 8 or not len(delta) or delta.max() < 1 << 8 * b)
            body = np.ascontiguousarray(delta.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()
            more = np.flatnonzero(c > 1)
            yield p, np.array([len(t), size, len(more), t[0]], "<u8").tobytes() + body + more.astype("<u4").tobytes() + c[more].astype("<u4").tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size, more, first = (int(x) for x in np.frombuffer(blob, "<u8", 4))
    wide = np.zeros((n - 1, 8), np.uint8)
    wide[:, :size] = np.frombuffer(blob, np.uint8, (n - 1) * size, 32).reshape(n - 1, size)
    tokens = np.concatenate([[np.uint64(first)], wide.view("<u8").reshape(-1)]).cumsum(dtype=np.uint64)
    counts = np.ones(n, np.int64)
    at = 32 + (n - 1) * size
    counts[np.frombuffer(blob, "<u4", more, at)] = np.frombuffer(blob, "<u4", more, at + 4 * more)
    return tokens, counts


def frequent(docs: DataFrame, text: str, words: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of TOKEN_BITS bits, sorted, and their df) of df >= least over all documents, at most TABLE: the most frequent."""
    rows = docs.select(text)
    n_parts = parts_for(rows)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            found = [*_packets(np.concatenate(held), RANGES * n_parts)]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], ["part", "packet"])

        for batch in batches:
            for s in shingle_sets(batch.column(0), words):
                held.append(s)
                size += len(s)
                if size > _TALLY:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packets: dict[int, list[bytes]] = {}
        for batch in batches:
            for p, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packets.setdefault(p, []).append(body)
        while packets:  # a range at a time: equal tokens are in one range
            found = [_unpacked(body) for body in packets.popitem()[1]]
            tokens, counts = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            order = np.argsort(tokens)
            tokens, counts = tokens[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            df = np.add.reduceat(counts, first)
            keep = df >= least
            yield pa.RecordBatch.from_arrays([pa.array(tokens[first][keep].astype(np.int64)), pa.array(df[keep])], ["token", "df"])

    table = rows.mapInArrow(lean(tally), "part int, packet binary").repartition(n_parts, "part").mapInArrow(lean(add), "token long, df long")
    table = materialise(table, "frequent")
    # The least df at which the table is small enough, from a histogram by powers of 2^(1/4).
    bins = {r["b"]: r["n"] for r in table.groupBy(F.floor(4 * F.log2("df")).alias("b")).agg(F.count("*").alias("n")).collect()}
    total, cut = 0, float("inf")
    for b in sorted(bins, reverse=True):
        total += bins[b]
        if total > TABLE:
            break
        cut = b
    kept = table.where(F.floor(4 * F.log2("df")) >= cut).toPandas() if bins and cut != float("inf") else None
    if kept is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    order = np.argsort(kept["token"].to_numpy())
    return kept["token"].to_numpy()[order].astype(np.uint64), kept["df"].to_numpy()[order]


class Prefixes:
    """Index entries of sets."""

    def __init__(self, tokens: np.ndarray, df: np.ndarray, percent: int = PERCENT, classes: tuple = CLASSES):
        self.tokens, self.percent, self.classes = tokens, percent, classes
        self.kind = np.searchsorted([c[0] for c in classes], df, "right").astype(np.int64)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(tokens >> np.uint64(TOKEN_BITS - 22)).astype(np.int64)] = True
        #: Sets below this size have no partner but equal sets.
        self.smallest = next(n for n in range(1, 10_000) if 100 * n >= percent * (n + 1))

    def kinds(self, s: np.ndarray) -> np.ndarray:
        """The class of each token: 0 rare, then the classes of CLASSES."""
        out = np.zeros(len(s), np.int64)
        maybe = np.flatnonzero(self.seen[(s >> np.uint64(42)).astype(np.int64)])
        if len(maybe):
            t = s[maybe] >> np.uint64(64 - TOKEN_BITS)
            at = np.minimum(np.searchsorted(self.tokens, t), len(self.tokens) - 1)
            hit = self.tokens[at] == t
            out[maybe[hit]] = self.kind[at[hit]]
        return out

    def entries(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entries, marks, order of the prefix's last token) of a set. Combinations are odd, rare tokens even. A mark says how
        much the sum over classes was before the entry's last token: for a partner of which at most t tokens may be
        lacking, the prefix is the entries of marks up to t."""
        n = len(s)
        if n < self.smallest:
            return np.array([set_number(s) & -2][: int(n > 0)], np.int64), np.zeros(int(n > 0), np.int32), 0
        need = n - -(-self.percent * n // 100) + 1
        kinds = self.kinds(s)
        rare = s[kinds == 0]
        one = np.uint64(1)
        if len(rare) >= need:
            rare = rare[:need]
            return (rare & ~one).view(np.int64), np.arange(need, dtype=np.int32), int(rare[-1] >> np.uint64(2))
        order = np.lexsort((s, kinds))
        kind = kinds[order].tolist()
        token = s[order]
        out, marks, last = [(rare & ~one)], [np.arange(len(rare), dtype=np.int32)], 0
        for level in {n.bit_length(), (100 * n // self.percent).bit_length()}:
            cuts = max(1, (1 << level) * (100 - self.percent) // 400)
            groups: dict[tuple[int, int], list[int]] = {}
            have, i, before = len(rare), len(rare), np.zeros(n, np.int32)
            sub = ((token >> np.uint64(5)) % np.uint64(cuts)).tolist()
            while have < need and i < n:
                g = groups.setdefault((kind[i], sub[i]), [])
                g.append(i)
                before[i] = have
                have += len(g) >= self.classes[kind[i] - 1][1]
                i += 1
            last = max(last, kind[i - 1] << 62 | int(token[i - 1] >> np.uint64(2)))
            for (k, g), members in groups.items():
                size = self.classes[k - 1][1]
                if len(members) >= size:
                    which = np.array([*combinations(members, size)])
                    h = np.full(len(which), level * 1009 + k * 97 + g, np.uint64)
                    for c in range(size):
                        h = mix(h * _ODD[2] + token[which[:, c]])
                    out.append(h | one)
                    marks.append(before[which[:, -1]])
        return np.concatenate(out).view(np.int64), np.concatenate(marks), min(last, (1 << 63) - 1)


def index(docs: DataFrame, doc_id: str, text: str, words: int, percent: int, classes: tuple) -> DataFrame:
    """A table of doc_id, hash (of the text), n, digest, last, entries, marks; ``own`` of docs' further columns."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Prefixes(*frequent(docs, text, words, classes[0][0]), percent, classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = sent.value
        for batch in batches:
            n, last, entries, marks = [], [], [], []
            for s in shingle_sets(batch.column(2), words):
                e, m, z = prefixes.entries(s)
                n.append(len(s))
                last.append(z)
                entries.append(e)
                marks.append(m)
            raw, edges = utf8(batch.column(2))
            raw = raw.tobytes()
            names = [digest(raw[a:b]) for a, b in zip(edges.tolist(), edges[1:].tolist())]
            at = pa.array(np.concatenate([[0], np.cumsum([len(e) for e in entries])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, x), *y]))) for x, y in ((np.int64, entries), (np.int32, marks))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(last, pa.int64()), *lists],
                ["doc_id", "hash", "n", "digest", "last", "entries", "marks"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    return materialise(rows.mapInArrow(lean(run), "doc_id long, hash long, n long, digest binary, last long, entries array<long>, marks array<int>"), "jaccard")


class Texts:
    """The texts of classes, fetched when they are first asked for. members: class, key and hash of the row that stands for it, digest."""

    def __init__(self, docs: DataFrame, members: DataFrame, doc_id: str, text: str, words: int):
        key = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID))
        self.docs, self.members, self.words = docs.select(key.alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")), members, words
        self.table: DataFrame | None = None

    def of(self, pairs: DataFrame) -> DataFrame:
        """class, text, for all classes of pairs(a, b) at least."""
        wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
        if self.table is not None:
            wanted = wanted.join(self.table.select("class"), "class", "left_anti")
        wanted = materialise(wanted.join(self.members, "class"), "jaccard-wanted")
        if self.table is None or not wanted.isEmpty():
            more = self._fetch(wanted)
            self.table = more if self.table is None else self.table.unionByName(more)
        return self.table

    def _fetch(self, wanted: DataFrame) -> DataFrame:
        spot = F.pmod(F.xxhash64("key", "hash"), F.lit(BITMAP))
        bit = F.shiftright(spot, 6).cast("int").alias("row"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(key, hash), {BITMAP}) % 64 as int))").alias("bit")
        bitmap = wanted.select(*bit).groupBy("row").agg(F.bit_or("bit").alias("bits"))  # BITMAP / 64 rows at most
        near = self.docs.select("key", "hash", "text", *bit).join(F.broadcast(bitmap), "row").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        found = near.select("key", "hash", "text").join(wanted, ["key", "hash"])

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of rows of equal id and hash, those of the class."""
            for batch in batches:
                raw, at = utf8(batch.column(2))
                raw = raw.tobytes()
                good = [digest(raw[a:b]) == c for a, b, c in zip(at.tolist(), at[1:].tolist(), batch.column(1).to_pylist(), strict=False)]
                yield batch.select([0, 2]).filter(pa.array(good, pa.bool_()))

        texts = found.select("class", "digest", "text").mapInArrow(lean(own), "class long, text string").dropDuplicates(["class"])
        return materialise(texts, "jaccard-texts")


def _need(x, y, percent: int):
    """The overlap of a link: ceil(p (x + y) / (100 + p))."""
    return F.ceil(F.lit(percent) * (x + y) / F.lit(100.0 + percent) - F.lit(1e-9))


def _meet(x: tuple, y: tuple, percent: int):
    """Whether an entry with (set size, mark) on either side is in both prefixes for a partner of that size."""
    need = _need(x[0], y[0], percent)
    return (x[1] <= x[0] - need) & (y[1] <= y[0] - need)


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose prefixes leave room for a link.

    Up to where the first of the two prefixes ends, a rare token of one that the other lacks is not shared at all."""
    of = lambda s: nodes.select(F.col("c").alias(s), *(F.col(k).alias(f"{k}_{s}") for k in ("n", "last", "entries")))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    is_rare = lambda e: e % 2 == 0
    both = both.withColumn("rare", F.size(F.filter(F.array_intersect("entries_a", "entries_b"), is_rare))).withColumn("ends", F.least("last_a", "last_b"))
    lacks = lambda s: F.size(F.filter(f"entries_{s}", lambda e: is_rare(e) & (F.shiftrightunsigned(e, 2) <= F.col("ends")))) - F.col("rare")
    need = _need(F.col("n_a"), F.col("n_b"), percent)
    return both.where((F.col("n_a") - lacks("a") >= need) & (F.col("n_b") - lacks("b") >= need)).select("a", "b")


def linked(x: bytes, y: bytes, words: int, percent: int) -> bool:
    """Whether two texts link, by their shingles themselves."""
    a, b = shingles_of(x, words), shingles_of(y, words)
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: Texts, percent: int) -> DataFrame:
    """a, b of those pairs of classes that link: hashes sort out pairs that don't, words decide on the others."""
    words = texts.words

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (left, i), (right, j) = utf8(batch.column(2)), utf8(batch.column(3))
            good = []
            for k, (x, y) in enumerate(zip(shingle_sets(batch.column(2), words), shingle_sets(batch.column(3), words), strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both) and linked(left[i[k] : i[k + 1]].tobytes(), right[j[k] : j[k + 1]].tobytes(), words, percent))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    table = texts.of(pairs)
    left, right = table.select(F.col("class").alias("a"), F.col("text").alias("ta")), table.select(F.col("class").alias("b"), F.col("text").alias("tb"))
    joined = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return materialise(joined.mapInArrow(lean(check), "a long, b long"), "jaccard-links")


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, root of every node that is no root: former components joined by further links(a, b) of their nodes."""
    if roots is None:
        return components(links)
    for side in "ab":
        at = roots.select(F.col("node").alias(side), F.col("root").alias("r"))
        links = links.join(at, side, "left").withColumn(side, F.coalesce("r", side)).drop("r")
    over = components(links)
    moved = roots.join(over.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left")
    return materialise(moved.select("node", F.coalesce("new", "root").alias("root")).unionByName(over), "jaccard-roots")


def _bands(n, percent: int):
    """The bands of set sizes of a set: sizes that can link are in equal or neighbouring ones, so a set stands in its own and the next."""
    band = F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent)) - F.lit(1e-9)).cast("int")
    return F.array(band, band + 1)


def members(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, classes: tuple = CLASSES) -> DataFrame:
    """A table of doc_id, hash (xxhash64 of the text), digest (of its words), n_shingles, component_id (the least doc_id) and root (a number
    of the component; null without words), a row for each row of docs."""
    spark, first_made = docs.sparkSession, made()
    table = index(docs, doc_id, text, words, percent, classes)
    lead = F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), "hash"))
    found = table.where("n > 0").groupBy("digest").agg(lead.alias("rep"), F.min("doc_id").alias("least"), *(F.first(k).alias(k) for k in ("n", "last", "entries", "marks")))
    # Numbers are given once, as the table is written.
    classes = materialise(found.select(F.monotonically_increasing_id().alias("class"), "digest", "rep.key", "rep.hash", "least", "n", "last", "entries", "marks"), "jaccard-classes")
    texts = Texts(docs, classes.select("class", "key", "hash", "digest"), doc_id, text, words)
    # Entries of several classes.
    entries = classes.select(F.col("class").alias("c"), "n", F.explode(F.arrays_zip("entries", "marks")).alias("x")).select("c", "n", F.col("x.entries").alias("e"), F.col("x.marks").alias("mark"))
    several = entries.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    shared = materialise(entries.join(several, "e"), "jaccard-shared")
    weights = materialise(shared.groupBy("c").agg(F.sum("df").alias("weight")), "jaccard-weights")
    nodes = classes.select(F.col("class").alias("c"), "n", "last", "entries").join(weights.select("c"), "c", "left_semi")
    shared = materialise(shared.join(weights, "c"), "jaccard-entries")

    def placed(roots: DataFrame | None) -> DataFrame:
        if roots is None:
            return shared.withColumn("root", F.col("c"))
        return shared.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))

    tried = roots = None
    for k in range(STARS):
        at = placed(roots)
        # The class that shares most, then others in an order of each round's own.
        lead = F.struct(F.col("weight") if k == 0 else F.xxhash64("c", F.lit(k)), "c", "n", "mark", "root")
        ends = at.groupBy("e").agg(F.max(lead).alias("p"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("e", "p")
        star = at.join(ends, "e").where((F.col("root") != F.col("p.root")) & _meet((F.col("n"), F.col("mark")), (F.col("p.n"), F.col("p.mark")), percent))
        star = star.select(F.least("c", "p.c").alias("a"), F.greatest("c", "p.c").alias("b")).distinct()
        if tried is not None:
            star = star.join(tried, ["a", "b"], "left_anti")
        star = materialise(star, "jaccard-star")
        if star.isEmpty():
            break
        tried = star if tried is None else tried.unionByName(star)
        roots = _joined(roots, verified(materialise(possible(star, nodes, percent), "jaccard-possible"), texts, percent))
    # Entries that still hold several components give the pairs across them.
    if tried is not None:
        at = materialise(placed(roots).select("e", "c", "n", "mark", "root"), "jaccard-placed")
        mixed = at.groupBy("e").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("e")
        rest = at.join(mixed, "e").withColumn("bands", _bands(F.col("n"), percent))
        x = rest.select("e", F.col("bands")[1].alias("band"), *(F.col(k).alias(f"{k}_a") for k in ("c", "n", "mark", "root")))
        # Pairs of one band meet in it from either side; pairs of neighbouring bands once, the smaller set in the next band.
        y = rest.select("e", F.explode("bands").alias("band"), *(F.col(k).alias(f"{k}_b") for k in ("c", "n", "mark", "root")))
        meet = _meet((F.col("n_a"), F.col("mark_a")), (F.col("n_b"), F.col("mark_b")), percent)
        across = x.join(y, ["e", "band"]).where((F.col("c_a") != F.col("c_b")) & (F.col("root_a") != F.col("root_b")) & meet)
        across = across.select(F.least("c_a", "c_b").alias("a"), F.greatest("c_a", "c_b").alias("b"))
        across = materialise(across.distinct().join(tried, ["a", "b"], "left_anti"), "jaccard-across")
        if not across.isEmpty():
            roots = _joined(roots, verified(materialise(possible(across, nodes, percent), "jaccard-possible"), texts, percent))
    named = classes.select("digest", F.col("class").alias("c"), "least")
    if roots is None:
        named = named.select("digest", F.col("c").alias("root"), F.col("least").alias("component_id"))
    else:
        named = named.join(roots.withColumnRenamed("node", "c"), "c", "left").select("digest", "least", F.coalesce("root", "c").alias("root"))
        named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("digest", "root", "component_id")
    out = table.select("doc_id", "hash", F.col("n").alias("n_shingles"), "digest").join(named, "digest", "left")
    out = out.select("doc_id", "hash", "digest", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root")
    last_made = made()
    out = materialise(out, "jaccard-members")
    remove_made(spark, first_made, last_made)
    return out


def join_components(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id. Links inside a component that its forming did not need are not looked for, so there is no count of links."""
    return members(docs, **options).select("doc_id", "n_shingles", "component_id")
