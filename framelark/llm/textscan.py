"""Vectorised word scanning over Arrow string columns.

Every Python stage of this subpackage sees texts as Arrow batches. The helpers
here work on the batch's UTF-8 buffer with numpy: no Python object is made per
word. A batch is cut into slices of a few MB, so memory does not depend on the
batch size; a text longer than a slice is hashed piece by piece.

Words get 64-bit hashes. Equal words always get equal hashes; two different
words share one with a chance of about 2**-64, which is the only way in which
results built on hashes could differ from results built on the words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

SLICE = 1 << 19  # bytes of text handled at once
_LONG = 512  # words longer than this are hashed by blake2b

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: word bytes of `[^\x20\x09-\x0D]+`
NON_SPACE = ~_SPACE
#: word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 2**64)
        _powers[:] = [
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]), dtype=np.uint64)
            for b in (_BASE, inverse)
        ]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE):
    """Yield (first row, last row + 1, bytes, offsets) of consecutive rows holding about `limit` bytes."""
    buf, offs = buffer_of(column)
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, end, buf[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


class Words:
    """The words of some texts: byte ranges, hashes and the first word of each text."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, wordbyte: np.ndarray):
        n = len(buf)
        mask = wordbyte[buf]
        edge = np.empty(n, bool)
        edge[:1] = True
        np.logical_not(mask[:-1], out=edge[1:])
        edge[offs[:-1][offs[:-1] < n]] = True
        self.start = np.flatnonzero(edge & mask)
        edge = np.empty(n, bool)
        edge[-1:] = True
        np.logical_not(mask[1:], out=edge[:-1])
        ends = offs[1:] - 1
        edge[ends[(ends >= 0) & (ends < n)]] = True
        self.end = np.flatnonzero(edge & mask) + 1
        self.first = np.searchsorted(self.start, offs)
        self.buf, self.offs = buf, offs

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        out = np.empty(len(self.start), np.uint64)
        w, total = 0, len(self.start)
        while w < total:
            base = int(self.start[w])
            stop = max(w + 1, int(np.searchsorted(self.end, base + SLICE, "right")))
            a, b = self.start[w:stop] - base, self.end[w:stop] - base
            if stop == w + 1 and b[0] - a[0] > _LONG:
                out[w] = _slow(self.buf[base : base + int(b[0])])
                w = stop
                continue
            pw, inv = _pow_tables(max(SLICE + 1, int(b[-1]) + 1))
            acc = _TABLE[self.buf[base : base + int(b[-1])]]
            acc *= pw[: len(acc)]
            acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(acc, dtype=np.uint64)])
            out[w:stop] = mix((acc[b] - acc[a]) * inv[a] + (b - a).astype(np.uint64))
            for k in np.flatnonzero(b - a > _LONG):
                out[w + k] = _slow(self.buf[base + int(a[k]) : base + int(b[k])])
            w = stop
        return out


def _slow(word: np.ndarray) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), "little"))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive word hashes, as if all were one text."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[k : len(h) - width + 1 + k]
    return mix(out)


def inside(first: np.ndarray, width: int, total: int) -> np.ndarray:
    """Which starts of `windows` lie in one text only."""
    counts = np.diff(first)
    left = np.repeat(first[1:], counts) - np.arange(total)
    return left[: max(0, total - width + 1)] >= width


def cover(starts: np.ndarray, width: int, total: int) -> np.ndarray:
    """Positions covered by the runs of `width` that begin at `starts`."""
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, total), -1)
    return np.cumsum(step[:total]) > 0


class Index:
    """A sorted table of different values, to look values up in. Built once, with a few bytes for each value.

    Found by a slot for the low bits; values whose slot another one took are searched for.
    """

    def __init__(self, table: np.ndarray, slots: int = 8):
        self.table = table
        bits = max(12, int(len(table) * slots).bit_length())
        self.low = np.uint64((1 << bits) - 1)
        own = np.arange(len(table), dtype=np.int32)
        self.slot = np.full(1 << bits, -1, np.int32)
        self.slot[table & self.low] = own
        self.late = np.flatnonzero(self.slot[table & self.low] != own)
        self.rest = table[self.late]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each value in the table, -1 if absent."""
        out = np.full(len(x), -1, np.int64)
        if not len(self.table) or not len(x):
            return out
        k = self.slot[x & self.low]
        taken = np.flatnonzero(k >= 0)
        k = k[taken]
        right = self.table[k] == x[taken]
        out[taken[right]] = k[right]
        if len(self.late):
            wrong = taken[~right]
            y = x[wrong]
            j = np.minimum(np.searchsorted(self.rest, y), len(self.rest) - 1)
            out[wrong] = np.where(self.rest[j] == y, self.late[j], -1)
        return out


def lookup(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each value in the sorted table, -1 if absent."""
    return Index(table).find(x) if len(x) else np.full(0, -1, np.int64)
