"""Byte-level BPE ids by the tokenizers library, each distinct piece encoded once per block of text.

A text is cut where the tokenizer's own pattern ends a match whatever follows, and the pieces' ids are concatenated: before a space that
a non-blank follows, after a run of letters that other ASCII follows, and after a single line break or tab between visible ASCII. So a
word is one piece with a comma or without. The ids of pieces already met are kept in a table of at most KEPT pieces; when it is full,
the half that was met least goes. Pieces are looked up by 64-bit hashes, and the bytes behind each hit are compared: a piece that
shares its hash with another is encoded by itself.

Added tokens (control strings as <|endoftext|>) in a text get the ids that the library's own call gives them; a text that
holds one is not cut, since blanks before it are split in another way. With ``plain=True`` they are ordinary text.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .shared import mix, ragged, segment_hashes, utf8

KEPT = 1 << 21
BLOCK = 1 << 20
_JOINED, _SENT = 2000, 10
#: Fixed by UTF-8: first and second bytes of the blanks beyond ASCII.
_WIDE_BLANK = {0xC2: (0x85, 0xA0), 0xE1: (0x9A,), 0xE2: (0x80, 0x81), 0xE3: (0x80,)}
_SPACE, _BREAK, _LETTER, _OTHER, _VISIBLE, _FIRST = (1 << k for k in range(6))
_LETTERS = {*range(0x41, 0x5B), *range(0x61, 0x7B)}
#: Kinds of each byte; _FIRST: any second byte after it makes a letter (U+00C0 to U+024F, U+0400 to U+047F), but for two signs.
_KINDS = bytes(
    _SPACE * (b == 0x20) | _BREAK * (b in (9, 10, 13)) | _LETTER * (b in _LETTERS) | _OTHER * (b < 0x80 and b not in _LETTERS) | _VISIBLE * (0x20 < b < 0x7F) | _FIRST * (b in (*range(0xC3, 0xCA), 0xD0, 0xD1))
    for b in range(256)
)
_SIGNS = (0x97, 0xB7)


def _shown(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether a character that is no blank begins at each of the places."""
    then = raw[places]
    good = then > 0x20
    wide = np.flatnonzero(good & np.isin(then, [*_WIDE_BLANK]))
    if len(wide):
        second = raw[np.minimum(places[wide] + 1, len(raw) - 1)]
        for first, seconds in _WIDE_BLANK.items():
            good[wide[(then[wide] == first) & np.isin(second, seconds)]] = False
    return good


def cuts(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of pieces, number of pieces of each text)."""
    here = np.zeros(len(raw) + 1, bool)
    kinds = np.frombuffer(raw.tobytes().translate(_KINDS), np.uint8)
    space = np.flatnonzero(kinds[:-1] & _SPACE)
    here[space[_shown(raw, space + 1)]] = True
    letter = (kinds & _LETTER) > 0
    letter[1:] |= (kinds[:-1] & _FIRST) > 0
    signs = np.flatnonzero(raw[:-1] == 0xC3) + 1
    letter[signs[np.isin(raw[signs], _SIGNS)]] = False
    here[1:-1] |= letter[:-1] & ((kinds[1:] & _OTHER) > 0)
    line = np.flatnonzero(kinds[1:-1] & _BREAK) + 1
    here[line[(kinds[line - 1] & kinds[line + 1] & _VISIBLE) > 0] + 1] = True
    here[at[:-1][at[1:] > at[:-1]]] = True  # a text that is not empty begins a piece, whatever it begins with
    starts = np.flatnonzero(here)
    return starts, np.diff(np.searchsorted(starts, at))


#: Bytes of a piece that are held in two words; of longer pieces the whole text is held too.
_SHORT = 16


class Pieces:
    """Byte strings raw[s:e]: a hash of each, and exact comparison by the first two words, the length and, of long ones, the text."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.raw, self.starts, self.lengths = raw, starts, (ends - starts).astype(np.int32)
        padded = np.concatenate([raw, np.zeros(2 * _SHORT - len(raw) % 8, np.uint8)])
        words = np.lib.stride_tricks.as_strided(padded.view(np.uint64), (len(raw) + 9,), (1,))  # the 8 bytes from each place
        mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        self.words = tuple(words[starts + 8 * k] & mask[np.clip(self.lengths - 8 * k, 0, 8)] for k in range(2))
        self.hashes = mix(self.words[0] ^ mix(self.words[1] + self.lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        long = np.flatnonzero(self.lengths > _SHORT)
        if len(long):
            n = self.lengths[long].astype(np.int64)
            stops = np.cumsum(n)
            self.hashes[long] ^= segment_hashes(raw[ragged(starts[long], n)], stops - n, stops)

    def differ(self, mine: np.ndarray, other, its: np.ndarray) -> np.ndarray:
        """Whether my pieces ``mine`` are other strings than the pieces ``its`` of other."""
        out = (self.lengths[mine] != other.lengths[its]) | (self.words[0][mine] != other.words[0][its]) | (self.words[1][mine] != other.words[1][its])
        long = np.flatnonzero(~out & (self.lengths[mine] > _SHORT))
        if len(long):
            n = self.lengths[mine[long]].astype(np.int64)
            same = self.raw[ragged(self.starts[mine[long]], n)] == other.raw[ragged(other.starts[its[long]], n)]
            out[long] = ~np.logical_and.reduceat(same, np.cumsum(n) - n)
        return out


class _Known:
    """Pieces of different hashes in a table of open addressing, with places in their concatenated ids and texts, and how often each was met."""

    TYPES = {"hashes": np.uint64, "first": np.uint64, "second": np.uint64, "lengths": np.int32, "starts": np.int64, "at": np.int64, "sizes": np.int32, "met": np.int32}

    def __init__(self, dtype: np.dtype):
        self.n, self.n_ids, self.n_raw = 0, 0, 0
        for name, kind in self.TYPES.items():
            setattr(self, name, np.zeros(0, kind))
        self.ids, self.raw, self.slots = np.zeros(0, dtype), np.zeros(0, np.uint8), np.full(1 << 12, -1, np.int32)

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.first, self.second

    def find(self, pieces: Pieces) -> np.ndarray:
        """The place of each piece here: -1 if it is new, -2 if another piece has its hash."""
        out, mask = np.full(len(pieces.hashes), -1, np.int64), len(self.slots) - 1
        if not self.n:
            return out
        todo, spot = np.arange(len(out)), (pieces.hashes & np.uint64(mask)).astype(np.int64)
        while len(todo):
            k = self.slots[spot]
            same = (k >= 0) & (self.hashes[k] == pieces.hashes[todo])
            out[todo[same]] = k[same]
            on = (k >= 0) & ~same
            todo, spot = todo[on], (spot[on] + 1) & mask
        hit = np.flatnonzero(out >= 0)
        self.met[out[hit]] += 1
        out[hit[pieces.differ(hit, self, out[hit])]] = -2
        return out

    def _place(self, first: int) -> None:
        """Give slots to the pieces from ``first`` on; to all, if the table is to be larger."""
        if 2 * self.n > len(self.slots):
            self.slots, first = np.full(1 << (2 * self.n).bit_length(), -1, np.int32), 0
        mask = len(self.slots) - 1
        todo = np.arange(first, self.n, dtype=np.int32)
        spot = (self.hashes[todo] & np.uint64(mask)).astype(np.int64)
        while len(todo):
            free = self.slots[spot] < 0
            self.slots[spot[free]] = todo[free]
            on = self.slots[spot] != todo  # taken before, or by another of these
            todo, spot = todo[on], (spot[on] + 1) & mask

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        have = getattr(self, name)
        if at + len(values) > len(have):
            have = np.concatenate([have[:at], np.zeros(max(len(values), at // 2), have.dtype)])
            setattr(self, name, have)
        have[at : at + len(values)] = values

    def add(self, pieces: Pieces, which: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Take in the pieces ``which``, of hashes that are not here; their ids lie one after the other."""
        n = np.where(pieces.lengths[which] > _SHORT, pieces.lengths[which], 0).astype(np.int64)
        raw, first = pieces.raw[ragged(pieces.starts[which], n)], self.n
        new = {"hashes": pieces.hashes[which], "first": pieces.words[0][which], "second": pieces.words[1][which], "lengths": pieces.lengths[which]}
        new |= {"starts": self.n_raw + np.cumsum(n) - n, "at": self.n_ids + np.cumsum(sizes) - sizes, "sizes": sizes, "met": np.zeros(len(which), np.int32)}
        for name, values in new.items():
            self._put(name, first, values)
        self._put("ids", self.n_ids, ids)
        self._put("raw", self.n_raw, raw)
        self.n, self.n_ids, self.n_raw = first + len(which), self.n_ids + len(ids), self.n_raw + len(raw)
        self._place(first)

    def halve(self) -> None:
        """Forget the pieces that were met least, all but half of KEPT at most."""
        met = self.met[: self.n]
        keep = np.argpartition(-met, KEPT // 2)[: KEPT // 2] if self.n > KEPT // 2 else np.arange(self.n)
        keep = np.sort(keep[met[keep] > 0])
        n, sizes = np.where(self.lengths[keep] > _SHORT, self.lengths[keep], 0).astype(np.int64), self.sizes[keep].astype(np.int64)
        self.ids, self.raw = self.ids[ragged(self.at[keep], sizes)], self.raw[ragged(self.starts[keep], n)]
        for name in self.TYPES:
            setattr(self, name, getattr(self, name)[keep])
        self.at, self.starts, self.met = np.cumsum(sizes) - sizes, np.cumsum(n) - n, self.met // 2
        self.n, self.n_ids, self.n_raw = len(keep), len(self.ids), len(self.raw)
        self.slots[:] = -1
        self._place(0)


class Encoder:
    def __init__(self, path: str | None = None, name: str = "byte_bpe_50k.json", plain: bool = False):
        # A task has one core; threads of the library would each keep memory of their own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.added = [] if plain else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if len(vocab) <= 1 << 16 else "<u4")
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)  # ids that begin with a space
        self.spaced[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.known = _Known(self.dtype)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each piece). Pieces of one space, a character that is no blank, and no other space or line break are encoded many at a
        time, but for those to be encoded alone."""
        blanks = np.concatenate([[0], np.cumsum(raw <= 0x20)])
        plain = (raw[starts] == 0x20) & (blanks[ends] - blanks[starts] == 1) & (ends - starts > 1) & ~alone
        plain[plain] = _shown(raw, starts[plain] + 1)
        data, sizes = raw.tobytes(), np.zeros(len(starts), np.int64)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        k = int(plain.sum())
        pieces = [data[a:b] for a, b in zip(starts[order].tolist(), ends[order].tolist(), strict=True)]
        out: list[np.ndarray] = []
        for i in range(0, k, _SENT * _JOINED):
            joined = [b"".join(pieces[j : min(j + _JOINED, k)]).decode() for j in range(i, min(i + _SENT * _JOINED, k), _JOINED)]
            out += self._encode(joined)
        if k:
            ids = np.concatenate(out)
            begins = np.flatnonzero(self.spaced[ids])
            if len(begins) != k:
                raise AssertionError("pieces and ids do not match")
            sizes[order[:k]] = np.diff(np.append(begins, len(ids)))
        odd: list[np.ndarray] = []
        for i in range(k, len(pieces), 10_000):
            odd += self._encode([p.decode() for p in pieces[i : i + 10_000]])
        sizes[order[k:]] = [len(x) for x in odd]
        ids = np.concatenate([*out, *odd]) if out or odd else np.zeros(0, self.dtype)
        # back to the order of the pieces
        first = np.zeros(len(order), np.int64)
        first[order] = np.cumsum(sizes[order]) - sizes[order]
        return ids[ragged(first, sizes)], sizes

    def encode_utf8(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each) of the texts raw[at[i]:at[i+1]]."""
        starts, counts = cuts(raw, at)
        holds = self._holding(raw, at)
        if holds.any():  # their inner cuts go
            text = np.repeat(np.arange(len(counts)), counts)
            keep = ~holds[text] | np.concatenate([[True], text[1:] != text[:-1]])
            starts, counts = starts[keep], np.where(holds, 1, counts)
        alone = np.repeat(holds, counts)
        edges = np.append(starts, len(raw))
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(raw)]).dictionary_encode()
        where = found.indices.to_numpy()
        raw, edges = utf8(found.dictionary)
        pieces = Pieces(raw, edges[:-1], edges[1:])
        place = self.known.find(pieces)
        hit, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        size = np.zeros(len(place), np.int64)
        size[hit] = self.known.sizes[place[hit]]
        if len(new):
            single = np.zeros(len(place), bool)
            single[where[alone]] = True
            more, size[new] = self._pieces(raw, edges[new], edges[new + 1], single[new])
        first = np.cumsum(size) - size
        ids = np.zeros(int(size.sum()), self.dtype)
        ids[ragged(first[hit], size[hit])] = self.known.ids[ragged(self.known.at[place[hit]], size[hit])]
        if len(new):
            ids[ragged(first[new], size[new])] = more
            fresh = new[place[new] == -1]
            fresh = fresh[np.sort(np.unique(pieces.hashes[fresh], return_index=True)[1])]  # one piece of a hash
            self.known.add(pieces, fresh, size[fresh], ids[ragged(first[fresh], size[fresh])])
            if self.known.n > KEPT:
                self.known.halve()
        lengths = size[where]
        out = ids[ragged(first[where], lengths)]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        piece = np.concatenate([[0], np.cumsum(counts)])
        return out, np.diff(sums[piece])

    def _holding(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each text holds an added token's string."""
        out = np.zeros(len(at) - 1, bool)
        data = raw.tobytes() if self.added else b""
        for token in self.added:
            i = data.find(token)
            while i >= 0:
                k = int(np.searchsorted(at, i, "right")) - 1
                if i + len(token) <= at[k + 1]:
                    out[k] = True
                    i = data.find(token, int(at[k + 1]))
                else:  # it goes across two texts
                    i = data.find(token, i + 1)
        return out

    def encode_column(self, column: pa.Array):
        """(first row, ids, ids of each row) for runs of rows of about BLOCK bytes."""
        raw, at = utf8(column)
        low = 0
        while low < len(at) - 1:
            high = max(low + 1, int(np.searchsorted(at, at[low] + BLOCK, "right")) - 1)
            yield low, *self.encode_utf8(raw[at[low] : at[high]], at[low : high + 1] - at[low])
            low = high


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str | None = None, name: str = "byte_bpe_50k.json", plain: bool = False) -> Encoder:
    """This process's encoder."""
    key = path, name, plain
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
