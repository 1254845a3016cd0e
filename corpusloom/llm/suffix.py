"""Repeated byte strings by suffix arrays: induced sorting over shards, and permuted common prefixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (in a smaller doc_id, or sooner in the
document). All is judged on the input, and strings never cross documents.

Shards. Every string of ``length`` bytes has an anchor: of its GRAM-byte grams the one of least hash, the first of equal
ones. It follows from the string alone, so all occurrences of a string have equal anchors and meet in the shard of the
anchor's hash. Neighbouring strings share anchors, so what is sent is not strings but contexts: the stretch of strings
that have one occurrence of an anchor, by place and hash. Of equal contexts in a task the first is sent and the
others are settled on the spot (all of their strings start earlier), and likewise in a shard: so copies of a document
or a passage are pre-aggregated, however many. An anchor that many different contexts of a task have is dealt by the contexts'
hashes, not to one task. Anchors that occur once repeat nothing. What is left, the different
contexts of repeated anchors, is fetched from the texts and decided by the shard's suffix array. Contexts of a crowded anchor are
cut into stretches of strings that begin at neighbouring distances before the anchor, the more the more crowded it is: those of a
stretch share a core of bytes, by whose hash they are dealt, so no string is parted from an equal one; of equal stretches
in a task the first goes on.

Hashes bring together and settle equal contexts (64 bits of the context, 64 of its anchor, its length and place); whatever else goes
is decided on bytes by a suffix array.

Suffix array. ``suffix_array`` classifies suffixes by SA-IS's types, sorts the leftmost-smaller substrings by an
induced pass, names them, sorts the string of names by the same routine and induces the whole array. The passes are linear:
over few symbols they go through the buckets in order and move each bucket's suffixes at once in numpy, over many (strings of
names, whose buckets are small) suffix by suffix. Common prefixes are found in text order: compared at irreducible places, one less than
before at the others. Suffixes with ``length`` bytes in common stand together, and all but the first in the corpus go.

Nulls: a null text is empty, a null doc_id comes before all others. Rows of equal doc_id are ordered by a hash of the
text; rows equal in both are one document and get equal results. Empty tables give no rows; other columns are kept
by ``annotate`` and ignored by ``find``. A text's length is bounded by what an Arrow batch of one row holds; its contexts are found
BLOCK bytes, or one text, at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import _power, lean, materialise, mix, parts_for, ragged, segment_hashes, utf8, _BASE, _INVERSE, _VALUE

LENGTH = 100
GRAM = 40
#: Bytes of text whose anchors are found at once, contexts held by a task before they are sent, bytes of a suffix array.
BLOCK, HELD, SHARD = 1 << 19, 150_000, 1 << 19
#: Ranges of grams to a partition, and contexts of one anchor beyond which it is crowded; each further SPREAD times as many halve its stretches again.
RANGES, CROWD, SPREAD = 8, 64, 4
#: Symbols up to which an induced pass goes bucket by bucket.
FEW = 1024
SALTS = 64
#: Stretches of crowded anchors whose first occurrence a task remembers.
SEEN = 500_000
_NO_ID = -(1 << 63)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


# Suffix arrays.


def _put(sa: np.ndarray, places: np.ndarray, chars: np.ndarray, at: np.ndarray, step: int) -> None:
    """Append places to their characters' buckets, in order, upwards (step 1) or downwards (step -1) from at."""
    order = np.argsort(chars, kind="stable")
    chars, places = chars[order], places[order]
    many = np.bincount(chars, minlength=len(at))
    rank = np.arange(len(chars)) - (np.cumsum(many) - many)[chars]
    sa[at[chars] + rank if step > 0 else at[chars] - 1 - rank] = places
    at += step * many


def _induce_each(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The suffixes, induced from leftmost-smaller ones in the given order, one by one."""
    n = len(text)
    count = np.bincount(text, minlength=sigma)
    ends = np.cumsum(count)
    chars, smaller, sa = text.tolist(), is_s.tolist(), [-1] * n
    tail, head = ends.tolist(), (ends - count).tolist()
    for j in lms[::-1].tolist():
        c = chars[j]
        tail[c] -= 1
        sa[tail[c]] = j
    for j in sa:  # reads what it writes further on
        if j > 0 and not smaller[j - 1]:
            c = chars[j - 1]
            sa[head[c]] = j - 1
            head[c] += 1
    tail = ends.tolist()
    for k in range(n - 1, -1, -1):
        j = sa[k]
        if j > 0 and smaller[j - 1]:
            c = chars[j - 1]
            tail[c] -= 1
            sa[tail[c]] = j - 1
    sa[0] = n - 1  # the end, which nothing stands before
    return np.array(sa, np.int64)


def _induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The suffixes, induced from leftmost-smaller ones in the given order."""
    if sigma > FEW:
        return _induce_each(text, is_s, lms, sigma)
    n = len(text)
    count = np.bincount(text, minlength=sigma)
    ends = np.cumsum(count)
    begins = ends - count
    sa = np.full(n, -1, np.int64)
    first = text[lms]
    order = np.argsort(first, kind="stable")
    lms, edge = lms[order], np.searchsorted(first[order], np.arange(sigma + 1))
    top = begins.copy()

    def send(found: np.ndarray, kind: bool, at: np.ndarray, step: int) -> None:
        before = found - 1
        before = before[before >= 0]
        before = before[is_s[before] == kind]
        if len(before):
            _put(sa, before, text[before], at, step)

    for c in range(sigma):
        done = begins[c]
        while done < top[c]:
            found, done = sa[done : top[c]].copy(), top[c]
            send(found, False, top, 1)
        if edge[c] < edge[c + 1]:
            send(lms[edge[c] : edge[c + 1]], False, top, 1)
    low = ends.copy()
    for c in range(sigma - 1, -1, -1):
        done = ends[c]
        while done > low[c]:
            found, done = sa[low[c] : done][::-1].copy(), low[c]
            send(found, True, low, -1)
        if begins[c] < top[c]:
            send(sa[begins[c] : top[c]][::-1].copy(), True, low, -1)
    sa[0] = n - 1  # the end, which nothing stands before
    return sa


def suffix_array(text: np.ndarray, sigma: int, apart: int | None = None) -> np.ndarray:
    """The suffixes of text in order. Its last symbol is 0 and stands nowhere else; symbols are below sigma. Suffixes that
    begin with the symbol ``apart`` count as all different."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    rise = np.sign(text[1:].astype(np.int64) - text[:-1])
    place = np.where(rise != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(place[::-1])[::-1]
    is_s = np.ones(n, bool)
    is_s[:-1] = rise[np.minimum(following, n - 2)] > 0
    is_lms = np.zeros(n, bool)
    is_lms[1:] = is_s[1:] & ~is_s[:-1]
    lms = np.flatnonzero(is_lms)
    sa = _induce(text, is_s, lms, sigma)
    found = sa[is_lms[sa]]
    # Names: equal where neighbours in order are the same substring, up to and with the next leftmost-smaller place.
    stop = np.full(n, n - 1)
    stop[lms[:-1]] = lms[1:]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(text.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
    long = stop[found] - found
    value = (sums[stop[found] + 1] - sums[found]) * _power(_INVERSE, n)[found]
    new = np.ones(len(found), bool)
    new[1:] = (long[1:] != long[:-1]) | (value[1:] != value[:-1])
    new[found == n - 1] = True
    if apart is not None:
        new |= text[found] == apart
    names = np.zeros(n, np.int64)
    names[found] = np.cumsum(new) - 1
    names = names[lms]
    kinds = int(new.sum())
    if kinds == len(lms):
        order = found
    else:
        order = lms[suffix_array(names, kinds)]
    return _induce(text, is_s, order, sigma)


def common_prefixes(text: np.ndarray, sa: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each place, in text order, the symbols in common with the suffix before it in the array; at most room of both."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    left = np.maximum(before - 1, 0)
    carried = (before > 0) & (i > 0)
    carried[1:] &= (text[:-1] == text[left[1:]]) & (room[:-1] > 0) & (room[left[1:]] > 0)
    at = np.flatnonzero(~carried & (before >= 0))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(text.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
    inverse = _power(_INVERSE, n)
    x, y = at, before[at]
    most = np.minimum(room[x], room[y])
    have = np.zeros(len(at), np.int64)
    step = 1 << max(0, int(most.max(initial=0)).bit_length())
    while step := step >> 1:
        can = np.flatnonzero(have + step <= most)
        a, b = x[can] + have[can], y[can] + have[can]
        same = (sums[a + step] - sums[a]) * inverse[a] == (sums[b + step] - sums[b]) * inverse[b]
        have[can[same]] += step
    out = np.zeros(n, np.int64)
    known = np.zeros(n, np.int64)
    known[at] = at
    known = np.maximum.accumulate(known)
    out[at] = have
    out = np.where(carried, np.maximum(out[known] - (i - known), 0), out)
    return out


def repeated(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, in order of the corpus, the starts of its strings of length bytes that an earlier place has."""
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"\x00".join(contexts) + b"\x00", np.uint8).astype(np.int16) + 2
    stops = np.cumsum(sizes + 1) - 1
    text[stops] = 1
    text = np.append(text, np.int16(0)).astype(np.uint16)
    room = np.append(np.repeat(stops, sizes + 1) - np.arange(len(text) - 1), 0)
    sa = suffix_array(text, 258, 1)
    shared = common_prefixes(text, sa, room)[sa] >= length
    group = np.cumsum(~shared) - 1
    first = np.minimum.reduceat(sa, np.flatnonzero(~shared))  # contexts lie in order, so the least place is the first
    gone = np.zeros(len(text), bool)
    gone[sa] = sa != first[group]
    places = np.flatnonzero(gone)
    begins = stops - sizes
    where = np.searchsorted(begins, places, "right") - 1
    edges = np.searchsorted(where, np.arange(len(contexts) + 1))
    return [places[a:b] - begins[k] for k, (a, b) in enumerate(zip(edges, edges[1:]))]


# Anchors and contexts.


def contexts(raw: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first start, anchor - first start, last start - first start, anchor hash, context hash) of all contexts."""
    n = len(raw)
    size = np.diff(at)
    docs = np.flatnonzero(size >= length)
    if not len(docs):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[raw] * _power(_BASE, n), out=sums[1:])
    inverse = _power(_INVERSE, n + 1)
    grams = mix((sums[gram:] - sums[: n - gram + 1]) * inverse[: n - gram + 1])
    bits = np.uint64(n.bit_length())
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    wide, width = 1, length - gram + 1
    while 2 * wide <= width:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < width:
        least = np.minimum(least[: len(least) - (width - wide)], least[width - wide :])
    many = size[docs] - length + 1
    start = ragged(at[docs], many)
    text = np.repeat(docs, many)
    anchor = (least[start] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(first[1:], len(start)) - 1
    low, high, anchor, text = start[first], start[last], anchor[first], text[first]
    whole = (sums[high + length] - sums[low]) * inverse[low]
    whole = mix(whole * _ODD + ((anchor - low) << 20 | (high - low)).astype(np.uint64))
    return text, low - at[text], anchor - low, high - low, grams[anchor], whole


def _ranges(n: int, wide: int) -> np.ndarray:
    """Where to part the hashes of anchors into n ranges of about equally many. An anchor has the least hash of ``wide`` grams on some
    string, so small hashes are common: the share of anchors below x grows as 1 - exp(-y) (1 + y / 2) with y = wide x."""
    y = np.concatenate([[0.0], np.geomspace(1e-7, max(wide, 2), 1 << 16)])
    share = 1 - np.exp(-y) * (1 + y / 2)
    at = np.interp(np.arange(1, n) / n, share / share[-1], y) / y[-1]
    return (np.minimum(at, 1 - 2.0**-40) * 2.0**64).astype(np.uint64)


def _planes(a: np.ndarray) -> bytes:
    """An array of 8-byte values, byte plane by byte plane, so that planes of little change compress."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(b: memoryview, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(kind).reshape(-1)


def _columns(body: bytes, kinds: list[str]) -> list[np.ndarray]:
    """The arrays of a packet: a byte that tells its kind, then planes."""
    view = memoryview(body)[1:]
    step = len(view) // len(kinds)
    return [_from_planes(view[k * step : (k + 1) * step], kind) for k, kind in enumerate(kinds)]


def _merge(doc: np.ndarray, version: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of documents, those that touch made one."""
    order = np.lexsort((low, version, doc))
    doc, version, low, high = doc[order], version[order], low[order], high[order]
    if not len(doc):
        return doc, version, low, high
    other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])])
    # Ends grow within a document; an offset for each document keeps the running maximum inside it.
    step = (np.cumsum(other) - 1) * (int(high.max()) + 1)
    most = np.maximum.accumulate(high + step)
    new = other.copy()
    new[1:] |= low[1:] + step[1:] > most[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], version[first], low[first], (most - step)[last]


_COLUMNS = ("doc", "version", "low", "shape", "gram", "whole")


def _settle(cols: dict[str, np.ndarray], length: int) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, ...]]:
    """(the first of all equal contexts, spans of the others). Equal are those of equal hash, of equal hash of the anchor and of equal
    length and place of it."""
    same = ("whole", "gram", "shape")
    order = np.lexsort((cols["low"], cols["version"], cols["doc"], *(cols[k] for k in reversed(same))))
    cols = {k: v[order] for k, v in cols.items()}
    first = np.zeros(len(order), bool)
    first[:1] = True
    for k in same:
        first[1:] |= cols[k][1:] != cols[k][:-1]
    rest = {k: v[~first] for k, v in cols.items()}
    return {k: v[first] for k, v in cols.items()}, _merge(rest["doc"], rest["version"], rest["low"], rest["low"] + (rest["shape"] & 0xFFFFF) + length)


def found_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans (key, version, low, high) to remove, of docs(key, version, text)."""
    n_parts = parts_for(docs)
    ranges = _ranges(RANGES * n_parts, length - gram)
    schema = "key long, version long, low long, high long, anchor long, gram long"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            every = {k: np.concatenate([h[k] for h in held]) for k in _COLUMNS}
            first, spans = _settle(every, length)
            part = np.searchsorted(ranges, first["gram"], "right")
            order = np.argsort(first["gram"], kind="stable")
            g = first["gram"][order]
            begins = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
            many = np.diff(np.append(begins, len(g)))
            hot = order[np.repeat(many > CROWD, many)]  # these go by their contexts, and the anchor's own range gets to know
            known = g[begins[many > CROWD]]
            home = np.searchsorted(ranges, known, "right")
            part[hot] = (mix(first["whole"][hot]) % np.uint64(RANGES * n_parts)).astype(np.int64)
            is_hot = np.zeros(len(part), bool)
            is_hot[hot] = True
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(RANGES * n_parts + 1))
            parts, bodies = [], []
            for p in np.flatnonzero(np.diff(edges)).tolist():
                every = order[edges[p] : edges[p + 1]]
                for kind, rows in ((b"\0", every[~is_hot[every]]), (b"\2", every[is_hot[every]])):
                    if len(rows):
                        rows = rows[np.argsort(first["gram"][rows])]
                        parts.append(p)
                        bodies.append(kind + b"".join(_planes(first[k][rows]) for k in _COLUMNS))
            for p in np.unique(home).tolist():
                parts.append(p)
                bodies.append(b"\3" + _planes(known[home == p]))
            doc = spans[0]
            cut = np.linspace(0, len(doc), max(1, min(RANGES * n_parts, len(doc) // 2000)) + 1).astype(int)
            for k, (a, b) in enumerate(zip(cut, cut[1:])):
                if b > a:
                    parts.append((k * 7 + int(doc[a])) % (RANGES * n_parts))
                    bodies.append(b"\1" + b"".join(_planes(x[a:b]) for x in spans))
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(bodies, pa.binary())], ["part", "body"])

        for batch in batches:
            raw, at = utf8(batch.column(2))
            key, version = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            i = 0
            while i < len(key):
                j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
                text, low, off, wide, gram_, whole = contexts(raw[at[i] : at[j]], at[i : j + 1] - at[i], length, gram)
                if len(text):
                    held.append({"doc": key[i + text], "version": version[i + text], "low": low, "shape": off << 20 | wide, "gram": gram_, "whole": whole})
                    size += len(text)
                if size > HELD:
                    yield out()
                    held, size = [], 0
                i = j
        if size:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = ["<i8"] * 4 + ["<u8"] * 2
        packets: dict[int, list[bytes]] = {}
        spans: list[list[np.ndarray]] = []
        for batch in batches:
            for p, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if body[0] == 1:
                    spans.append(_columns(body, kinds[:4]))
                else:
                    packets.setdefault(p, []).append(body)
        while packets:  # a range at a time: equal grams are in one range, but for those of hot anchors
            bodies = packets.popitem()[1]
            hot = [_columns(body, kinds) for body in bodies if body[0] == 2]
            found = [_columns(body, kinds) for body in bodies if body[0] == 0] + hot
            known = [_columns(body, ["<u8"])[0] for body in bodies if body[0] == 3] + [np.unique(p[4]) for p in hot]
            del bodies, hot
            if not found:
                continue
            # Grams that come once, here and elsewhere, repeat nothing.
            known = np.unique(np.concatenate([np.zeros(0, np.uint64), *known]))
            grams = np.concatenate([p[4] for p in found])
            order = np.argsort(grams)
            same = grams[order][1:] == grams[order][:-1]
            keep = np.isin(grams, known)
            keep[order[1:][same]] = keep[order[:-1][same]] = True
            first, settled = _settle({k: np.concatenate([p[c] for p in found])[keep] for c, k in enumerate(_COLUMNS)}, length)
            spans.append([*settled])
            order = np.argsort(first["gram"], kind="stable")
            g = first["gram"][order]
            several = np.isin(g, known)
            several[1:] |= g[1:] == g[:-1]
            several[:-1] |= g[1:] == g[:-1]
            rows = order[several]
            low = first["low"][rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (first["doc"][rows], first["version"][rows], low, low + (first["shape"][rows] & 0xFFFFF) + length, low + (first["shape"][rows] >> 20), first["gram"][rows].view(np.int64))],
                ["key", "version", "low", "high", "anchor", "gram"],
            )
        if spans:
            found = _merge(*(np.concatenate([s[k] for s in spans]) for k in range(4)))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in found), pa.nulls(len(found[0]), pa.int64()), pa.nulls(len(found[0]), pa.int64())], ["key", "version", "low", "high", "anchor", "gram"])

    met = docs.select("key", "version", "text").mapInArrow(lean(send), "part int, body binary").repartition(n_parts, "part").mapInArrow(lean(meet), schema)
    met = materialise(met, "suffix-contexts", 128)  # packets are larger than texts
    open_ = met.where("gram is not null")
    many = F.count("*")
    often = open_.groupBy("gram").agg(many.alias("n")).where(F.col("n") > CROWD).select("gram", F.ceil(F.log(F.col("n") / CROWD) / F.log(F.lit(float(SPREAD)))).cast("int").alias("level"))
    # An anchor's contexts are dealt to SALTS keys, so that a hot one is not joined in one task.
    often = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    open_ = open_.withColumn("salt", F.pmod(F.xxhash64("key", "low"), F.lit(SALTS)).cast("int"))
    open_ = open_.join(often, ["gram", "salt"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
    asked = open_.groupBy("key", "version").agg(F.collect_list(F.struct("low", "high", "anchor", "level", "gram")).alias("asked"))
    wide = length - gram + 1  # distances before an anchor at which a string may begin

    def stretches(level: int) -> np.ndarray:
        """The first distance of each stretch, and their end."""
        return np.unique(np.arange(0, min(1 << min(level, 30), wide) + 1) * wide // min(1 << min(level, 30), wide))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], tuple[int, int, int]] = {}
        for batch in batches:
            raw, at = utf8(batch.column(2))
            asked = batch.column(3)
            edges = asked.offsets.to_numpy()
            flat = asked.values
            many = np.diff(edges)
            take = ragged(edges[:-1].astype(np.int64), many)
            row = np.repeat(np.arange(batch.num_rows), many)
            low, high, anchor, level, grams = (flat.field(k).to_numpy(zero_copy_only=False)[take] for k in range(5))
            key, version = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            grams = grams.view(np.uint64)
            plain = np.flatnonzero(level == 0)
            # Context, first byte, end, and first byte and end of the core, of each stretch.
            found = [(plain, low[plain], high[plain], anchor[plain], anchor[plain] + gram)]
            for k in np.unique(level[level > 0]).tolist():
                mine, cuts = np.flatnonzero(level == k), stretches(k)
                for a, b in zip(cuts.tolist(), cuts[1:].tolist()):  # strings that begin a to b - 1 bytes before the anchor
                    begin, end = np.maximum(low[mine], anchor[mine] - b + 1), np.minimum(high[mine], anchor[mine] - a + length)
                    good = end - begin >= length
                    of = mine[good]
                    found.append((of, begin[good], end[good], anchor[of] - a, anchor[of] + length - b + 1))
            of, low_, high_, core, core_end = (np.concatenate(x) for x in zip(*found, strict=True))
            row_, key_ = row[of], grams[of].copy()
            keep = np.ones(len(of), bool)
            some = np.arange(len(plain), len(of))
            if len(some):
                base = at[row_[some]]
                start, end = np.concatenate([base + core[some], base + low_[some]]), np.concatenate([base + core_end[some], base + high_[some]])
                order = np.argsort(start, kind="stable")
                h = np.empty(len(start), np.uint64)
                h[order] = segment_hashes(raw, start[order], end[order], strong=True)
                key_[some] = mix(grams[of[some]] * _ODD + h[: len(some)] + (anchor[of[some]] - core[some]).astype(np.uint64) + np.uint64(1))
                # Of equal stretches that this task has met, the first goes on; all strings of the others start earlier.
                names = zip(key_[some].tolist(), h[len(some) :].tolist(), strict=True)
                places = zip(key[row_[some]].tolist(), version[row_[some]].tolist(), low_[some].tolist(), strict=True)
                for i, name, place in zip(some.tolist(), names, places, strict=True):
                    before = seen.get(name)
                    if before is not None and before < place:
                        keep[i] = False
                    elif before is not None or len(seen) < SEEN:
                        seen[name] = place
            gone = np.flatnonzero(~keep)
            if len(gone):
                spans = _merge(key[row_[gone]], version[row_[gone]], low_[gone], high_[gone])
                doc = pa.array(spans[0], pa.int64())
                yield pa.RecordBatch.from_arrays([doc, doc, *(pa.array(x, pa.int64()) for x in spans[1:]), pa.nulls(len(spans[0]), pa.binary())], ["gram", "key", "version", "low", "high", "context"])
            rows = np.flatnonzero(keep)
            body = raw.tobytes()
            begin, end = at[row_[rows]] + low_[rows], at[row_[rows]] + high_[rows]
            for i in range(0, len(rows), 20_000):
                s = rows[i : i + 20_000]
                texts = [body[a:b] for a, b in zip(begin[i : i + 20_000].tolist(), end[i : i + 20_000].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x, pa.int64()) for x in (key_[s].view(np.int64), key[row_[s]], version[row_[s]], low_[s], high_[s])), pa.array(texts, pa.binary())],
                    ["gram", "key", "version", "low", "high", "context"],
                )

    fetched = docs.join(asked, ["key", "version"]).select("key", "version", "text", "asked")
    fetched = fetched.mapInArrow(lean(fetch), "gram long, key long, version long, low long, high long, context binary").repartition(n_parts, "gram").sortWithinPartitions("gram")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            key, version, low = (table.column(k).to_numpy() for k in (1, 2, 3))
            order = np.lexsort((low, version, key))
            texts = table.column(5).to_pylist()
            gone = repeated([texts[i] for i in order.tolist()], length)
            many = np.array([len(x) for x in gone])
            row = np.repeat(order, many)
            begin = low[row] + np.concatenate([np.zeros(0, np.int64), *gone])
            found = _merge(key[row], version[row], begin, begin + length)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["key", "version", "low", "high"])

        held, size = [], 0
        for batch in batches:
            settled = batch.column(5).is_null()
            if settled.true_count:
                yield pa.RecordBatch.from_arrays([batch.filter(settled).column(k) for k in (1, 2, 3, 4)], ["key", "version", "low", "high"])
                batch = batch.filter(pc.invert(settled))
                if not batch.num_rows:
                    continue
            grams = batch.column(0).to_numpy()
            held.append(batch)
            size += batch.column(5).nbytes
            if size > SHARD:
                # The last gram may go on in the next batch: its contexts wait.
                cut = int(np.searchsorted(grams, grams[-1]))
                if cut or len({held[0].column(0)[0].as_py(), int(grams[-1])}) > 1:
                    wait = held.pop().slice(cut)
                    if cut:
                        held.append(batch.slice(0, cut))
                    while held and held[-1].column(0)[0].as_py() == grams[-1]:
                        wait = pa.Table.from_batches([held.pop(), wait]).combine_chunks().to_batches()[0]
                    if held:
                        yield shard(held)
                    held, size = [wait], wait.column(5).nbytes
        if held:
            yield shard(held)

    decided = materialise(fetched.mapInArrow(lean(decide), "key long, version long, low long, high long"), "suffix-spans")
    return met.where("gram is null").drop("anchor", "gram").unionByName(decided)


def annotate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """row (all columns of docs but the text, as a struct), spans (of bytes to remove, merged), kept (the
    other bytes) and kept_text (those as text; parts of characters that a cut leaves are left out)."""
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID))
    keyed = docs.select(key.alias("key"), F.col(text).alias("text"))
    twice = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "suffix-ids")
    rows = docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("row"), key.alias("key"), F.col(text).alias("text"))
    one = F.lit(0).cast("long")
    if twice.isEmpty():
        rows = rows.withColumn("version", one)
        short = keyed.withColumn("version", one)
    else:
        mark = twice.withColumn("more", F.lit(True))
        version = F.when(F.col("more"), F.xxhash64("text")).otherwise(one)
        rows = rows.join(mark, "key", "left").withColumn("version", version).drop("more")
        short = keyed.join(mark, "key", "left").withColumn("version", version).drop("more").dropDuplicates(["key", "version"])
    spans = found_spans(short, length, gram)
    spans = spans.groupBy("key", "version").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    joined = rows.join(spans, ["key", "version"], "left").select("row", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("low", pa.int64()), ("high", pa.int64())])
        for batch in batches:
            raw, at = utf8(batch.column(1))
            raw = raw.tobytes()
            out, kept, texts = [], [], []
            for a, b, found in zip(at.tolist(), at[1:].tolist(), batch.column(2).to_pylist()):
                body = raw[a:b]
                merged: list[list[int]] = []
                for s in sorted((x["low"], x["high"]) for x in found or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                parts, place = [], 0
                for low, high in merged:
                    parts.append(body[place:low])
                    place = high
                parts.append(body[place:])
                kept.append(b"".join(parts))
                texts.append("".join(x.decode(errors="ignore") for x in parts))
                out.append([{"low": x, "high": y} for x, y in merged])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span)), pa.array(kept, pa.binary()), pa.array(texts, pa.string())], ["row", "spans", "kept", "kept_text"])

    schema = T.StructType([joined.schema["row"], T.StructField("spans", T.ArrayType(T.StructType.fromDDL("low long, high long"))), T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(lean(cut), schema)


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    out = annotate(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), text="text", doc_id="doc_id", **options)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    out = out.select(F.col("row.doc_id").alias("doc_id"), F.octet_length("kept").cast("long").alias("n_kept"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return out.select("doc_id", (F.col("n_kept") + F.col("n_removed")).alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")

