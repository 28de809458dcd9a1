"""Cuts texts where a tokenizer's own pre-tokenizer must cut, with numpy over UTF-8 bytes.

A piece is a stretch of text whose ids do not depend on what surrounds it, so each
distinct piece needs encoding once, and a text's ids are those of its pieces in
order. Only cuts that hold for every text are made; where a rule is unsure, no cut
is made and the piece grows. Pieces are found by 64-bit hashes and then compared byte by byte.
"""

from __future__ import annotations

import ctypes
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Hands freed memory of the C heap back to the system; glibc alone has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
#: What workers keep from task to task.
_KEPT: list = []

_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
#: Bytes that are hashed or compared in one step.
STRETCH = 1 << 19
#: Random numbers of each byte at each of the first places of a range.
_PLACES = 64
_EARLY = _RNG.integers(0, 2**64, _PLACES * 256, dtype=np.uint64)

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: Marks that never join with a following character, and that start no special token or contraction.
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in '.,;:!?()"-']] = True
#: First bytes of characters that may be white space beyond ASCII.
_MAYBE = np.zeros(256, bool)
_MAYBE[[0xC2, 0xE1, 0xE2, 0xE3, *range(0x1C, 0x20), 0x85]] = True


#: What a byte is, as bits, for bytes.translate.
SPACE, MAYBE, ALNUM, MARK, HIGH, BLANK = 1, 2, 4, 8, 16, 32
_HIGH, _BLANK = np.arange(256) >= 0x80, np.arange(256) == 32
_KIND = sum(bit * table.astype(np.uint8) for bit, table in ((SPACE, _SPACE), (MAYBE, _MAYBE), (ALNUM, _ALNUM), (MARK, _MARK), (HIGH, _HIGH), (BLANK, _BLANK))).astype(np.uint8).tobytes()


def _kinds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds of each byte, of the one before and of the one after; a blank stands beyond both ends."""
    kind = np.frombuffer((b" " + data.tobytes() + b" ").translate(_KIND), np.uint8)
    return kind[1:-1], kind[:-2], kind[2:]


def scrambled(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on all bits of the 64-bit number."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def range_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges that are in order and do not overlap.

    Each byte and its place in the range give a random number, and these are added up: no text has an
    algebraic twin, as with polynomials modulo a power of two. Memory is that of one STRETCH.
    """
    h = np.zeros(len(start), np.uint64)
    for lo in range(0, len(data), STRETCH):
        hi = min(len(data), lo + STRETCH)
        a, z = np.searchsorted(stop, lo, "right"), np.searchsorted(start, hi, "left")
        if a >= z:
            continue
        s, e = np.maximum(start[a:z], lo), np.minimum(stop[a:z], hi)
        place = np.arange(s[0], hi, dtype=np.int32)
        place -= np.repeat(start[a:z].astype(np.int32), np.diff(np.append(s, hi)))
        byte = data[s[0] : hi]
        late = np.flatnonzero(place >= _PLACES)
        x = _EARLY[((place & (_PLACES - 1)) << 8) | byte]
        if len(late):
            x[late] = scrambled(place[late].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _BYTE[byte[late]])
        total = np.zeros(hi - s[0] + 1, np.uint64)
        np.cumsum(x, out=total[1:])
        h[a:z] += total[e - s[0]] - total[s - s[0]]
    h ^= (stop - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return scrambled(h)


#: The first bytes of a little-endian word, by their number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)


def _gathered(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of all bytes of some ranges, range by range."""
    at = np.cumsum(size) - size
    place = np.arange(size.sum(), dtype=np.int32)
    place += np.repeat((start - at).astype(np.int32), size)
    return place


def hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; those of up to 7 bytes are one to one."""
    size = stop - start
    words = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    h = scrambled((words[start] & _FIRST[np.minimum(size, 7)]) | (size.astype(np.uint64) << np.uint64(56)))
    long = np.flatnonzero(size > 7)
    if len(long):
        n = size[long]
        at = np.cumsum(n) - n
        h[long] = range_hashes(data[_gathered(start[long], n)], at, at + n)
    return h


def byte_level_cuts(data: np.ndarray) -> np.ndarray:
    """Sure cuts of the byte-level pattern (a blank joins the word after it); True at a piece's first byte."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if not n:
        return cut
    kind, prev, nxt = _kinds(data)
    word_next = nxt & (SPACE | MAYBE) == 0
    cut[:n] = (kind & BLANK != 0) & word_next
    lone = (kind & (SPACE | BLANK) == SPACE) & word_next & (prev & (SPACE | HIGH) == 0)
    cut[:n] |= lone
    cut[1:] |= lone
    cut[:n] |= _mark_meets_word(kind, prev)
    return cut


def _mark_meets_word(kind: np.ndarray, prev: np.ndarray) -> np.ndarray:
    return (kind & MARK != 0) & (prev & ALNUM != 0) | (kind & ALNUM != 0) & (prev & MARK != 0)


def word_level_cuts(data: np.ndarray) -> np.ndarray:
    """Sure cuts where white space only separates words; True at a piece's first byte."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if not n:
        return cut
    kind, prev, _ = _kinds(data)
    cut[:n] = (kind ^ prev) & SPACE != 0
    cut[:n] |= _mark_meets_word(kind, prev)
    return cut


class HashIndex:
    """Open-addressed table from well-mixed 64-bit hashes (not 0) to row numbers; doubles as it fills."""

    def __init__(self, bits: int = 16) -> None:
        self.bits, self.count = bits, 0
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it has none."""
        out, slot = np.full(len(keys), -1, np.int64), self._slots(keys)
        left = np.arange(len(keys))
        while len(left):
            got = self.keys[slot]
            hit = got == keys[left]
            out[left[hit]] = self.rows[slot[hit]]
            on = ~hit & (got != 0)
            left, slot = left[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def add(self, keys: np.ndarray) -> None:
        """Numbers distinct new keys, in their order, from ``count`` on."""
        while 2 * (self.count + len(keys)) > len(self.keys):
            full = np.flatnonzero(self.keys)
            held, rows = self.keys[full], self.rows[full]
            self.bits += 1
            self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._put(held, rows)
        self._put(keys, np.arange(self.count, self.count + len(keys), dtype=np.int32))
        self.count += len(keys)

    def _put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            own = self.keys[slot] == keys
            self.rows[slot[own]] = rows[own]
            keys, rows, slot = keys[~own], rows[~own], (slot[~own] + 1) & (len(self.keys) - 1)


def _appended(store: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``store`` with ``more`` behind its first ``used`` entries; room doubles as it fills."""
    if used + len(more) > len(store):
        store = np.concatenate([store[:used], np.zeros(max(used, len(more), 1024), store.dtype)])
    store[used : used + len(more)] = more
    return store


class PieceTable:
    """What is known of pieces seen before: ``width`` and a slice of ``flat`` for each.

    A piece is found by its hash and, unless the hash is one to one, compared with the bytes that the table holds; one that differs
    is encoded anew, so no collision gives a wrong result. At most ``limit`` pieces of ``most_bytes`` bytes together are
    kept; when more come, the table starts anew, so memory stays bounded however many distinct pieces
    a corpus has. A piece longer than a STRETCH is encoded and not kept.
    """

    def __init__(self, cuts, encode, limit: int = 1_000_000, most_bytes: int = 1 << 24) -> None:
        self.cuts, self.encode, self.limit, self.most_bytes = cuts, encode, limit, most_bytes
        self.clear()

    def clear(self) -> None:
        self.index = HashIndex()
        self.at, self.width, self.spot, self.size = (np.zeros(0, np.int32) for _ in range(4))
        self.flat, self.used = np.zeros(0, np.int32), 0
        self.raw, self.held = np.zeros(0, np.uint8), 0

    def _found(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The row of each piece; pieces lie side by side from the first byte on. -1: another piece has its hash."""
        h = np.maximum(hashes(data, starts, stops), np.uint64(1))
        row = self.index.find(h)
        new = np.flatnonzero(row < 0)
        if len(new):
            keys, where, back = np.unique(h[new], return_index=True, return_inverse=True)
            if self.index.count and (self.index.count + len(keys) > self.limit or self.held + len(data) > self.most_bytes):
                self.clear()
                new = np.arange(len(h))
                keys, where, back = np.unique(h, return_index=True, return_inverse=True)
            raw, at = data.tobytes(), new[where]
            parts = [raw[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist())]
            width, flat = self.encode(parts)
            row[new] = self.index.count + back
            size, n = stops[at] - starts[at], self.index.count
            self.at = _appended(self.at, n, self.used + np.cumsum(width) - width)
            self.width = _appended(self.width, n, width)
            self.spot = _appended(self.spot, n, self.held + np.cumsum(size) - size)
            self.size = _appended(self.size, n, size)
            self.flat, self.used = _appended(self.flat, self.used, flat), self.used + len(flat)
            self.raw, self.held = _appended(self.raw, self.held, np.frombuffer(b"".join(parts), np.uint8)), self.held + int(size.sum())
            self.index.add(keys)
        size = stops - starts
        same = self.size[row] == size
        long = np.flatnonzero(same & (size > 7))  # shorter ones are told apart by their hashes
        if len(long):
            n = size[long]
            differ = np.flatnonzero(self.raw[_gathered(self.spot[row[long]].astype(np.int64), n)] != data[_gathered(starts[long], n)])
            same[long[np.searchsorted(np.cumsum(n), differ, "right")]] = False
        return np.where(same, row, -1)

    def lookup(self, texts: list[bytes], with_ids: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Width of each piece of the texts in order, their ids in order (if asked for), and for each text its first piece and the end."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(x) for x in texts])
        cut = self.cuts(data)
        cut[0] = True
        cut[ends] = True
        starts = np.flatnonzero(cut)
        stops = starts[1:]
        starts = starts[:-1]
        first = np.searchsorted(starts, np.concatenate([[0], ends]))
        widths, ids, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], 0
        while at < len(starts):
            z = max(at + 1, int(np.searchsorted(stops, starts[at] + STRETCH, "right")))
            some = data[starts[at] : stops[z - 1]]
            a, b = starts[at:z] - starts[at], stops[at:z] - starts[at]
            row = self._found(some, a, b) if len(some) <= STRETCH else np.full(z - at, -1)
            width, odd = self.width[row].astype(np.int64) if self.index.count else np.zeros(z - at, np.int64), np.flatnonzero(row < 0)
            begin = self.at[row].astype(np.int64) if self.index.count else np.zeros(z - at, np.int64)
            flat = self.flat
            if len(odd):
                raw = some.tobytes()
                width[odd], more = self.encode([raw[x:y] for x, y in zip(a[odd].tolist(), b[odd].tolist())])
                begin[odd] = self.used + np.cumsum(width[odd]) - width[odd]
                flat = np.concatenate([self.flat[: self.used], more])
            widths.append(width)
            if with_ids and width.any():
                ids.append(flat[np.repeat(begin - np.cumsum(width) + width, width) + np.arange(width.sum())])
            at = z
        return np.concatenate(widths), np.concatenate(ids), first[:-1], first[1:]

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and each text's number of ids."""
        width, ids, first, stop = self.lookup(texts, True)
        total = np.concatenate([[0], np.cumsum(width)])
        return ids, total[stop] - total[first]


def in_batches(texts: list[bytes], most: int = 500_000):
    """Slices of the list with about ``most`` bytes each; a longer text is a slice of its own."""
    at, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield at, i
            at, size = i, 0
        size += len(x)
    if at < len(texts):
        yield at, len(texts)


def kept(make):
    """``make`` with its last result remembered: a worker keeps it from task to task, until a task that does not need it."""
    made = lru_cache(maxsize=1)(make)
    _KEPT.append(made)
    return made


def give_back(keeps=None) -> None:
    """Frees what earlier tasks of the worker kept, but for the results of ``keeps``, and hands unused memory back to the system."""
    for made in _KEPT:
        if made is not keeps:
            made.cache_clear()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def frugal(run, keeps=None):
    """``run`` over record batches, giving unused memory back on the way and at the end: workers live on from task to task."""

    def batches(given):
        give_back(keeps)
        for n, out in enumerate(run(given)):
            yield out
            if n % 8 == 7:
                give_back(keeps)
            else:
                pa.default_memory_pool().release_unused()
        out = None
        give_back(keeps)

    return batches


def eased(run, *args):
    """``run`` for one group, giving unused memory back after it."""
    try:
        return run(*args)
    finally:
        give_back()
