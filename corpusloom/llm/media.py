"""Media columns: bytes as baseline JPEG pictures, and thumbnails and hashes from JPEG scans.

Storing. A text's UTF-8 bytes, filled with bytes 0 to a positive multiple of 64, are the coefficients of 8 x 8 blocks:
byte b is the quantised coefficient ``b - BIAS`` at the next place in zigzag order, with a quantiser of 1, so nothing is
lost (samples would be: their transform is rounded). The blocks, in rows of about the square root of their number and
filled up with zero blocks, are a grey baseline JPEG with a restart interval of one block. A comment segment holds the
payload's length. Equal texts give equal files.

Reading. Markers are parsed, the scan's stuffing and restart markers are removed, and each restart interval is
Huffman-decoded. Files of one component and one block an interval (those written here) are decoded in numpy, all
blocks of a batch in step: step k looks up the next code of every block. Any other baseline file (several
components, sampling factors, longer intervals or none) is decoded block by block. The DC coefficients, dequantised,
are a thumbnail of one luminance value to a block; its differences along 8 rows of 9 values give a 64-bit hash.

A text of any length is one picture of up to 65535 x 65535 samples. Nulls: a null doc_id is kept. A null text is empty, 64 bytes of 0. A null picture, or one that is no baseline JPEG, gives null fields.
Repeated rows are each handled; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, ragged, utf8

BIAS = 96
BATCH = 1 << 20
TAG = b"payload:"


def _lengths_dc() -> dict[int, int]:
    return {0: 6, 1: 4, 2: 4, 3: 3, 4: 2, 5: 2, 6: 4, 7: 3, 8: 6, 9: 8, 10: 8, 11: 8}


def _lengths_ac() -> dict[int, int]:
    """Code lengths of run/size symbols: short for texts, whose coefficients are seldom 0."""
    out = {s: n for s, n in _lengths_dc().items() if 1 <= s <= 8}
    out |= {0x00: 6, 0xF0: 8}
    out |= {0x10 | s: 10 for s in range(1, 9)}
    out |= {r << 4 | s: 14 for r in range(2, 16) for s in range(1, 9)}
    return out


def _table(lengths: dict[int, int]) -> tuple[bytes, bytes]:
    """BITS and HUFFVAL of code lengths."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)), bytes(order)


def codes(bits: bytes, values: bytes) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length): canonical codes in order of length."""
    out, code, at = {}, 0, 0
    for n, count in enumerate(bits, 1):
        for s in values[at : at + count]:
            out[s] = (code, n)
            code += 1
        at += count
        code <<= 1
    return out


@lru_cache(maxsize=64)
def lookup(bits: bytes, values: bytes) -> np.ndarray:
    """For each next 16 bits: code length << 8 | symbol, 0 for no code."""
    out = np.zeros(1 << 16, np.int32)
    for s, (code, n) in codes(bits, values).items():
        out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | s
    return out


DC, AC = _table(_lengths_dc()), _table(_lengths_ac())


def _words(table: tuple[bytes, bytes], run: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits, number of bits) for each coefficient of -128 .. 255 after ``run`` zeros: the code, then the value."""
    book = codes(*table)
    word, size = np.zeros(384, np.uint32), np.zeros(384, np.int64)
    for v in range(-128, 256):
        n = abs(v).bit_length()
        found = book.get(run << 4 | n)
        if found:
            word[v + 128], size[v + 128] = found[0] << n | (v if v >= 0 else v + (1 << n) - 1), found[1] + n
    return word, size


_DC_WORD, _DC_SIZE = _words(DC, 0)
_AC = [_words(AC, r) for r in range(16)]
_AC_WORD, _AC_SIZE = np.array([a[0] for a in _AC]), np.array([a[1] for a in _AC])
_EOB, _ZRL = codes(*AC)[0x00], codes(*AC)[0xF0]


def shape(blocks: int) -> tuple[int, int]:
    """Blocks in a row, and rows."""
    wide = int(np.ceil(np.sqrt(blocks)))
    return wide, -(-blocks // wide)


def _segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


_FRONT = b"\xff\xd8" + _segment(0xDB, b"\x00" + b"\x01" * 64)
_BACK = (
    _segment(0xC4, b"\x00" + DC[0] + DC[1]) + _segment(0xC4, b"\x10" + AC[0] + AC[1]) + _segment(0xDD, b"\x00\x01") + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)


def _head(payload: int, wide: int, high: int) -> bytes:
    return _FRONT + _segment(0xFE, TAG + str(payload).encode()) + _segment(0xC0, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 1) + b"\x01\x11\x00") + _BACK


def _bits(coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entropy-coded bytes, bytes of each block) of rows of 64 coefficients, each block by itself and not stuffed."""
    n = len(coefficients)
    flat = coefficients.astype(np.int64)
    at = np.flatnonzero(flat[:, 1:].reshape(-1))
    block, place = at // 63, at % 63 + 1
    value = flat[block, place]
    before = np.concatenate([[0], place[:-1]])
    before[np.concatenate([[True], block[1:] != block[:-1]])[: len(at)]] = 0
    run = place - before[: len(at)] - 1
    last = np.zeros(n, np.int64)
    last[block] = place  # the last wins: places ascend
    zrl = np.flatnonzero(run >= 16)
    ending = np.flatnonzero(last < 63)
    long = ragged(np.zeros(len(zrl), np.int64), run[zrl] // 16)
    # Symbols in order of (block, place): the DC, the codes for 16 zeros, the coefficients, the end of the block.
    word = np.concatenate([_DC_WORD[flat[:, 0] + 128], np.full(len(long), _ZRL[0], np.uint32), _AC_WORD[run % 16, value + 128], np.full(len(ending), _EOB[0], np.uint32)])
    size = np.concatenate([_DC_SIZE[flat[:, 0] + 128], np.full(len(long), _ZRL[1]), _AC_SIZE[run % 16, value + 128], np.full(len(ending), _EOB[1])])
    many = np.repeat(zrl, run[zrl] // 16)
    key = np.concatenate([np.arange(n) * 256, block[many] * 256 + 2 * place[many], block * 256 + 2 * place + 1, ending * 256 + 255])
    order = np.argsort(key, kind="stable")
    word, size, block = word[order], size[order], key[order] // 256
    ends = np.cumsum(size)
    first = np.searchsorted(block, np.arange(n))
    begin = (ends - size)[first]
    bits = np.diff(np.append(begin, ends[-1]))
    nbytes = (bits + 7) // 8
    start = np.cumsum(nbytes) - nbytes
    bit = ends - size - begin[block] + 8 * start[block]
    byte = bit >> 3
    shifted = word.astype(np.uint64) << (40 - size - (bit & 7)).astype(np.uint64)
    total = int(nbytes.sum())
    out = np.zeros(total + 5)
    for k in range(5):
        out += np.bincount(byte + k, ((shifted >> np.uint64(32 - 8 * k)) & np.uint64(255)).astype(float), total + 5)
    out = out[:total].astype(np.uint8)
    fill = 8 * nbytes - bits
    out[start + nbytes - 1] |= ((1 << fill) - 1).astype(np.uint8)
    return out, nbytes


def encode(raw: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A JPEG for each text raw[at[i]:at[i+1]]."""
    size = np.diff(at)
    blocks = np.maximum(1, (size + 63) // 64)
    shapes = [shape(b) for b in blocks.tolist()]
    full = np.array([w * h for w, h in shapes])
    first = np.cumsum(full) - full
    coefficients = np.zeros((int(full.sum()), 64), np.int16)
    payload = ragged(first, blocks)
    coefficients[payload] = -BIAS
    coefficients.reshape(-1)[ragged(first * 64, size)] += raw
    data, nbytes = _bits(coefficients)
    # Where each byte goes: after its file's head, past stuffed zeros, and past the restart markers of earlier blocks.
    ff = data == 0xFF
    stuffed = np.cumsum(ff) - ff
    start = np.cumsum(nbytes) - nbytes
    inner = np.concatenate([stuffed, [int(ff.sum())]])
    length = nbytes + inner[np.append(start[1:], len(data))] - inner[start]
    file = np.repeat(np.arange(len(full)), full)
    number = np.arange(len(file)) - first[file]
    ends = number == full[file] - 1
    heads = [_head(64 * b, w, h) for b, (w, h) in zip(blocks.tolist(), shapes, strict=True)]
    head = np.array([len(h) for h in heads])
    # A block's length with the marker after it: a restart marker, or the end of the picture.
    whole = length + 2
    whole[number == 0] += head[file[number == 0]]
    stop = np.cumsum(whole)
    begin = stop - length - 2
    out = np.zeros(int(stop[-1]), np.uint8)
    shift = np.repeat(begin - start - inner[start], nbytes)
    out[np.arange(len(data)) + stuffed + shift] = data
    out[stop - 2] = 0xFF
    out[stop - 1] = np.where(ends, 0xD9, 0xD0 + number % 8)
    edges = np.concatenate([[0], stop[ends]])
    for h, a in zip(heads, edges.tolist()):
        out[a : a + len(h)] = np.frombuffer(h, np.uint8)
    blob = out.tobytes()
    return [blob[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist())]


class Picture:
    """What the markers of a baseline JPEG say."""

    def __init__(self, data: bytes):
        self.quant: dict[int, bytes | tuple] = {}
        self.tables: dict[int, tuple[bytes, bytes]] = {}
        self.interval, self.payload, self.parts = 0, None, None
        if data[:2] != b"\xff\xd8":
            raise ValueError("no JPEG")
        at = 2
        while True:
            while at < len(data) and data[at] != 0xFF:
                at += 1
            while at < len(data) and data[at] == 0xFF:
                at += 1
            if at + 3 > len(data):
                raise ValueError("the file ends before its scan")
            marker, n = data[at], int.from_bytes(data[at + 1 : at + 3], "big")
            body = data[at + 3 : at + 1 + n]
            at += 1 + n
            if marker == 0xDB:
                while body:
                    wide, k = body[0] >> 4, body[0] & 15
                    self.quant[k] = struct.unpack(">64H", body[1:129]) if wide else body[1:65]
                    body = body[129 if wide else 65 :]
            elif marker == 0xC4:
                while body:
                    m = sum(body[1:17])
                    self.tables[body[0]] = (body[1:17], body[17 : 17 + m])
                    body = body[17 + m :]
            elif marker == 0xDD:
                self.interval = int.from_bytes(body[:2], "big")
            elif marker == 0xFE and body.startswith(TAG):
                self.payload = int(body[len(TAG) :])
            elif marker in (0xC0, 0xC1):
                bits, self.height, self.width, n_parts = struct.unpack(">BHHB", body[:6])
                if bits != 8:
                    raise ValueError("samples are not of 8 bits")
                self.parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n_parts)}
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not baseline")
            elif marker == 0xDA:
                if self.parts is None:
                    raise ValueError("a scan before its frame")
                self.order = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                self.scan = at
                return

    def simple(self) -> tuple | None:
        """The tables' keys of a picture of one component and one block an interval."""
        if len(self.parts) == 1 and self.interval == 1:
            _, dc, ac = self.order[0]
            return self.tables[dc], self.tables[0x10 | ac]
        return None


def _extend(v, n):
    return v - ((1 << n) - 1) if n and v < 1 << (n - 1) else v


def decode_slowly(data: bytes, p: Picture) -> np.ndarray:
    """The thumbnail of the first component of any baseline scan, block by block."""
    chunk, segments, at = bytearray(), [], p.scan
    while at < len(data):
        b = data[at]
        if b == 0xFF:
            then = data[at + 1] if at + 1 < len(data) else 0xD9
            at += 2
            if then == 0:
                chunk.append(0xFF)
            elif 0xD0 <= then <= 0xD7:
                segments.append(chunk)
                chunk = bytearray()
            elif then != 0xFF:
                break
            else:
                at -= 1
            continue
        chunk.append(b)
        at += 1
    segments.append(chunk)
    most_h, most_v = max(h for h, _, _ in p.parts.values()), max(v for _, v, _ in p.parts.values())
    single = len(p.order) == 1
    of = {c: p.parts[c] for c, _, _ in p.order}
    luma = next(iter(p.parts))
    own_w = -(-p.width * of.get(luma, (1, 1, 0))[0] // most_h)
    own_h = -(-p.height * of.get(luma, (1, 1, 0))[1] // most_v)
    across = -(-own_w // 8) if single else -(-p.width // (8 * most_h))
    down = -(-own_h // 8) if single else -(-p.height // (8 * most_v))
    plan = [(c, lookup(*p.tables[dc]), lookup(*p.tables[0x10 | ac]), *((1, 1) if single else of[c][:2])) for c, dc, ac in p.order]
    h0, v0 = (1, 1) if single else of[luma][:2]
    thumb = np.zeros((down * v0, across * h0))
    quant = p.quant[p.parts[luma][2]][0]
    mcu, n_mcu = 0, across * down
    for chunk in segments:
        bits, n_bits, pos = int.from_bytes(chunk + b"\xff" * 8, "big"), 8 * len(chunk) + 64, 0

        def take(n: int) -> int:
            return bits >> (n_bits - pos - n) & ((1 << n) - 1)

        before = dict.fromkeys(of, 0)
        for _ in range(p.interval or n_mcu):
            if mcu >= n_mcu:
                break
            for c, dc, ac, h, v in plan:
                for k in range(h * v):
                    if pos > n_bits - 64:
                        raise ValueError("the scan ends early")
                    found = int(dc[take(16)])
                    if not found:
                        raise ValueError("no such code")
                    pos += found >> 8
                    n = found & 255
                    before[c] += _extend(take(n), n)
                    pos += n
                    if c == luma:
                        thumb[mcu // across * v + k // h, mcu % across * h + k % h] = before[c]
                    place = 1
                    while place < 64:
                        found = int(ac[take(16)])
                        if not found:
                            raise ValueError("no such code")
                        pos += found >> 8
                        run, n = found >> 4 & 15, found & 15
                        if n == 0 and run < 15:
                            break
                        pos += n
                        place += run + 1
            mcu += 1
    if mcu < n_mcu:
        raise ValueError("the scan ends early")
    return thumb[: -(-own_h // 8), : -(-own_w // 8)] * quant / 8 + 128


def decode_blocks(scans: list[bytes], keys: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(64 x blocks coefficients, blocks of each scan) of scans of one block an interval, all blocks in step."""
    raw = np.frombuffer(b"".join(scans), np.uint8)
    file_at = np.concatenate([[0], np.cumsum([len(s) for s in scans])]).astype(np.int64)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    then = raw[ff + 1]
    keep = np.ones(len(raw), bool)
    keep[ff[then == 0] + 1] = False
    marks = ff[(then >= 0xD0) & (then <= 0xD9)]
    keep[marks] = keep[marks + 1] = False
    place = np.concatenate([[0], np.cumsum(keep)])
    clean = raw[keep]
    # An interval begins with each scan and after each restart marker; a scan ends with its end marker.
    restarts = marks[raw[marks + 1] != 0xD9] + 2
    begins = np.sort(np.concatenate([file_at[:-1], restarts]))
    counts = np.diff(np.searchsorted(begins, file_at))
    window = np.zeros(len(clean), np.uint64)
    padded = np.concatenate([clean, np.full(8, 0xFF, np.uint8)]).astype(np.uint64)
    for k in range(5):
        window = window << np.uint64(8) | padded[k : k + len(clean)]
    window = np.concatenate([window, np.full(8, (1 << 40) - 1, np.uint64)]).view(np.int64)
    dc, ac = lookup(*keys[0]), lookup(*keys[1])
    bit = place[begins] * 8
    stop = np.append(place[begins[1:]], len(clean)) * 8
    n = len(bit)
    out = np.zeros((64, n), np.int16)

    def symbol(bit: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        w, shift = window[bit >> 3], 40 - (bit & 7)
        found = table[(w >> (shift - 16)) & 0xFFFF]
        if not found.all():
            raise ValueError("no such code")
        length, size = found >> 8, found & 15
        v = (w >> (shift - length - size)) & ((1 << size) - 1)
        v -= np.where(v < (1 << size) >> 1, (1 << size) - 1, 0)
        return bit + length + size, found >> 4 & 15, size, v

    bit, _, _, out[0] = symbol(bit, dc)
    live, at = None, np.ones(n, np.int64)  # live: blocks that go on, None for all
    ended = bit.copy()
    for _ in range(64):
        if live is None and not n or live is not None and not len(live):
            break
        bit, run, size, v = symbol(bit, ac)
        stopped = (size == 0) & (run < 15)
        if live is None and not run.any() and not stopped.any():
            out[int(at[0])] = v
            at += 1
            if at[0] == 64:
                ended, live = bit, np.zeros(0, np.int64)
            continue
        if live is None:
            live = np.arange(n)
        at = at + run
        if (at[~stopped] > 63).any():
            raise ValueError("a block of more than 64 coefficients")
        put = size > 0
        out[at[put], live[put]] = v[put]
        at = at + 1
        done = stopped | (at > 63)
        ended[live[done]] = bit[done]
        live, bit, at = live[~done], bit[~done], at[~done]
    if n and (((ended + 7) >> 3) * 8 != stop).any():
        raise ValueError("an interval has other bits than its block")
    return out, counts


def hashes(dc: np.ndarray, firsts: np.ndarray, wide: np.ndarray, high: np.ndarray) -> list[str]:
    """Difference hashes of thumbnails that lie one after the other in dc."""
    rows = (np.arange(8)[None] * high[:, None]) // 8
    cols = (np.arange(9)[None] * wide[:, None]) // 9
    grid = dc[firsts[:, None, None] + rows[:, :, None] * wide[:, None, None] + cols[:, None, :]]
    bits = np.packbits((grid[:, :, 1:] > grid[:, :, :-1]).reshape(len(firsts), 64), axis=1)
    return [x.tobytes().hex() for x in bits]


_FIELDS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width long, height long, thumb_hash string"
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]


def describe(pictures: list[bytes | None]) -> list[dict]:
    """Dimensions and thumbnail hash of each picture, and what it stores."""
    out: list[dict] = [dict.fromkeys(_NAMES) for _ in pictures]
    same: dict[tuple, list[tuple[int, Picture]]] = {}
    for i, data in enumerate(pictures):
        if data is None:
            continue
        out[i] |= {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
        try:
            p = Picture(data)
            keys = p.simple()
            if keys:
                same.setdefault(keys, []).append((i, p))
            else:
                thumb = decode_slowly(data, p)
                h, w = thumb.shape
                out[i] |= {"width": p.width, "height": p.height, "thumb_hash": hashes(thumb.reshape(-1), np.zeros(1, np.int64), np.array([w]), np.array([h]))[0]}
        except (ValueError, KeyError, IndexError, struct.error):
            continue
    for keys, found in same.items():
        try:
            _decode_same(pictures, keys, found, out)
        except (ValueError, IndexError):  # one of them is broken: each by itself
            for one in found:
                try:
                    _decode_same(pictures, keys, [one], out)
                except (ValueError, IndexError):
                    continue
    return out


def _decode_same(pictures: list, keys: tuple, found: list[tuple[int, Picture]], out: list[dict]) -> None:
    values, counts = decode_blocks([pictures[i][p.scan :] for i, p in found], keys)
    wide = np.array([-(-p.width // 8) for _, p in found])
    high = np.array([-(-p.height // 8) for _, p in found])
    if (counts != wide * high).any():
        raise ValueError("other blocks than the frame has")
    firsts = np.cumsum(counts) - counts
    quant = np.array([p.quant[next(iter(p.parts.values()))[2]][0] for _, p in found])
    marks = hashes(values[0] * np.repeat(quant, counts) / 8 + 128, firsts, wide, high)
    stored = None
    for (i, p), first, mark in zip(found, firsts.tolist(), marks, strict=True):
        out[i] |= {"width": p.width, "height": p.height, "thumb_hash": mark}
        if p.payload is not None:
            if stored is None:
                stored = np.ascontiguousarray((values + BIAS).T.astype(np.uint8)).reshape(-1)
            data = stored[64 * first : 64 * first + p.payload].tobytes()
            out[i] |= {"payload_bytes": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "tail_crc32": zlib.crc32(data[-64:])}


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    sums, low = np.concatenate([[0], np.cumsum(sizes + 64)]), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(sums, sums[low] + BATCH, "right")) - 1)
        yield low, high
        low = high


def to_jpeg(text: Column) -> Column:
    """A picture column from a text column."""

    def run(texts: pd.Series) -> pd.Series:
        raw, at = utf8(pa.array(texts, pa.string()))
        out: list[bytes] = []
        for low, high in _runs(np.diff(at)):
            out += encode(raw[at[low] : at[high]], at[low : high + 1] - at[low])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "binary")(text)


def read_jpeg(media: Column) -> Column:
    """A struct of the fields of ``describe`` from a picture column."""

    def run(pictures: pd.Series) -> pd.DataFrame:
        data = [bytes(x) if x is not None else None for x in pictures]
        out: list[dict] = []
        for low, high in _runs(np.array([len(x or b"") for x in data], np.int64)):
            out += describe(data[low:high])
        frame = pd.DataFrame(out, columns=_NAMES)
        for name, kind in (f.split() for f in _FIELDS.split(", ")):
            frame[name] = frame[name].astype("Int64" if kind == "long" else object)
        return frame

    return F.pandas_udf(run, _FIELDS)(media)


def store(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and the fields of ``describe``: each text stored as a picture in a table of the shared folder, and read back from it."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    stored = materialise(docs.select(F.col(doc_id).alias("doc_id"), size.alias("n_bytes"), to_jpeg(F.col(text)).alias("media")), "media", compression="zstd")
    rows = stored.select("doc_id", "n_bytes", read_jpeg(F.col("media")).alias("m"))
    return rows.select("doc_id", "n_bytes", *(F.col(f"m.{n}").alias(n) for n in _NAMES))
