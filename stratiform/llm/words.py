"""Words of Arrow text columns as numpy arrays: places, rows and 64-bit hashes, without a Python loop over words.

A hash of a word is a polynomial over random byte values, taken as a difference of prefix sums, then mixed. A
hash of a window is the same over word hashes. Rows are worked on in pieces of about `PIECE` bytes, so memory
depends on neither the batch nor the table; a longer text is one piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 21
BLOCK = 1 << 17
SPACE = bytes([0x20, *range(0x09, 0x0E)])
ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def word_bytes(kind: str) -> np.ndarray:
    """Which bytes belong to words. `space`: all but ASCII white space; `alnum`: digits, letters and non-ASCII."""
    inside = np.ones(256, bool)
    if kind == "space":
        inside[list(SPACE)] = False
    elif kind == "alnum":
        inside[:128] = False
        inside[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
    elif kind == "line":
        inside[10] = False
    else:
        raise ValueError(kind)
    return inside


class Poly:
    """Polynomial hashing modulo 2**64; two seeds give independent hashes."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.bytes = rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        odd = int(rng.integers(2**60, 2**62)) * 4 + 3
        self.base, self.inverse = odd % 2**64, pow(odd, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * BLOCK)
            ones = np.ones(size, np.uint64)
            ones[1:] = self.base
            self.up = np.multiply.accumulate(ones)
            ones[1:] = self.inverse
            self.down = np.multiply.accumulate(ones)
        return self.up, self.down

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of spans whose starts and ends rise; bytes stand for their random values. Worked on in blocks of values."""
        out = np.empty(len(start), np.uint64)
        low = 0
        while low < len(start):
            first = int(start[low])
            high = int(np.searchsorted(start, first + BLOCK))
            own = values[first : int(end[high - 1])]
            if own.dtype == np.uint8:
                own = self.bytes[own]
            up, down = self.powers(len(own) + 1)
            sums = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(own * up[: len(own)], out=sums[1:])
            at = start[low:high] - first
            out[low:high] = mix((sums[end[low:high] - first] - sums[at]) * down[at])
            low = high
        return out


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


POLY, POLY2 = Poly(20240501), Poly(20240502)


class Words:
    """Words of a run of rows. `row` counts from 0 in the run; `first` has one entry a row and one more."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        self.data, self.offsets, self.inside = data, offsets, inside
        word = np.zeros(len(data) + 2, bool)
        word[1:-1] = inside[data]
        at_row = np.zeros(len(data) + 1, bool)
        at_row[offsets] = True
        self.start = np.flatnonzero(word[1:] & (~word[:-1] | at_row))
        self.end = np.flatnonzero(word[:-1] & (~word[1:] | at_row))
        self.first = np.searchsorted(self.start, offsets)
        self.n = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.n)

    def hashes(self, poly: Poly = POLY) -> np.ndarray:
        return poly.spans(self.data, self.start, self.end)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each; where each begins and ends there."""
        size = self.end - self.start
        place = np.cumsum(size + 1) - size - 1
        out = np.full(int(size.sum()) + len(size), 32, np.uint8)
        out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = self.data[self.inside[self.data]]
        return out.tobytes(), place, place + size

    def windows(self, hashes: np.ndarray, k: int, poly: Poly = POLY) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of k words within one row."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:n] == self.row[k - 1 :])
        return at, poly.spans(hashes, at, at + k)

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value a word over each row."""
        sums = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64))
        np.cumsum(values, out=sums[1:])
        return sums[self.first[1:]] - sums[self.first[:-1]]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def runs(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about `limit` bytes; every row is in one run."""
    if not len(column):
        return
    data, offsets = texts(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters (`str.isalpha`); characters beyond the basic plane count as none."""
    out, high = ASCII_LETTER[data], np.flatnonzero(data >= 0x80)
    if len(high):
        some = data[high]
        points = np.frombuffer(some.tobytes().decode().encode("utf-32-le"), "<u4")
        out[high] = alphabet()[np.minimum(points, 0xFFFF)][np.cumsum((some & 0xC0) != 0x80) - 1]
    return out


@cache
def alphabet() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0xFFFF)] + [False])


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The spans with a space before each; where each begins, and the end."""
    size = end - start
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    inner = np.arange(int(size.sum()))
    out[inner + np.repeat(np.arange(1, len(size) + 1), size)] = data[inner + np.repeat(start - np.cumsum(size) + size, size)]
    return out.tobytes(), np.concatenate([[0], np.cumsum(size + 1)])


class Known:
    """32-bit ids of words by the words' 64-bit hashes, in sorted arrays; emptied when a run would take it beyond `limit` words."""

    def __init__(self, limit: int):
        self.limit = limit
        self.empty()

    def empty(self) -> None:
        self.keys, self.flat = np.zeros(0, np.uint64), np.zeros(0, "<u4")
        self.begin = self.size = np.zeros(0, np.int64)

    def missing(self, distinct: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.arange(len(distinct))
        return np.flatnonzero(self.keys[np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)] != distinct)

    def ids(self, hashes: np.ndarray, learn: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and their number by word. `learn` takes places of words that are not known
        and returns ids, where those of each place begin, and how many they are."""
        if not len(hashes):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        order = np.argsort(hashes)
        ranked = hashes[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        distinct, first, place = ranked[new], order[new], np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        missing = self.missing(distinct)
        if len(self.keys) and len(self.keys) + len(missing) > self.limit:
            self.empty()
            missing = np.arange(len(distinct))
        if len(missing):
            flat, begin, size = learn(first[missing])
            at = np.searchsorted(self.keys, distinct[missing])
            self.keys, self.begin, self.size = (np.insert(x, at, y) for x, y in ((self.keys, distinct[missing]), (self.begin, begin + len(self.flat)), (self.size, size)))
            self.flat = np.concatenate([self.flat, flat])
        slot = np.searchsorted(self.keys, distinct)
        own = self.size[slot][place]
        return self.flat[np.arange(int(own.sum())) + np.repeat(self.begin[slot][place] - np.cumsum(own) + own, own)], own
