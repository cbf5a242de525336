"""Byte-level views of text columns, shared by the operators of this subpackage.

Tasks see Arrow batches. A batch is cut into pieces of a few MB, and each piece
is one numpy buffer holding the whole UTF-8 bytes of its rows plus the row
offsets, so hashes of words, lines and windows are array expressions.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function on a task's batches that gives freed memory back to the system in the end: Spark uses a Python worker again, in other stages too."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return own


def thrifty_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function on a group."""

    def own(table: pa.Table) -> pa.Table:
        out = run(table)
        _give_back()
        return out

    return own


@dataclass
class Piece:
    """Rows [first, last) of a batch; `data` holds their bytes end to end."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a string column into pieces of about `size` bytes; null is empty. A longer text is a piece of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        yield Piece(first, last, raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit sums so that every bit depends on all of them."""
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


class Rolling:
    """Hash of any byte span of a buffer, from one prefix sum; equal spans hash alike wherever they stand.

    Long spans can be built to collide (it is a polynomial modulo 2^64), so it only deals
    bytes to groups and never decides that two spans are equal.
    """

    def __init__(self, data: np.ndarray):
        n = 1 << max(20, int(len(data)).bit_length())
        self.power, self.inverse = _powers(n)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _M1)

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])


def word_spans(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word, a run of bytes outside [\\x20\\x09-\\x0D]."""
    inside = ~_WHITE[piece.data]
    edge = np.zeros(len(piece.data) + 1, bool)
    edge[piece.offsets] = True
    prev = np.zeros(len(piece.data), bool)
    prev[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~prev | edge[:-1]))
    nxt = np.zeros(len(piece.data), bool)
    nxt[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~nxt | edge[1:])) + 1
    row = np.searchsorted(piece.offsets, start, "right") - 1
    return start, end, row


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [low, high), one after the other."""
    size = high - low
    return np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)


def codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each span of the buffer, alike for spans of equal bytes only, and the spans by number."""
    ends = np.append(0, np.cumsum(end - start))
    kind, width = (pa.binary(), np.int32) if ends[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    spans = pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(ends.astype(width)), pa.py_buffer(data[ranges(start, end)])])
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of BLAKE2 for each span of the buffer."""
    code, spans = codes(data, start, end)
    return np.frombuffer(b"".join([hashlib.blake2b(s, digest_size=8).digest() for s in spans.to_pylist()]), np.uint64)[code]


def run_codes(code: np.ndarray, k: int) -> np.ndarray:
    """A number for each run of k codes, alike for equal runs only."""
    out, width = code, 1
    while width < k:
        step = min(width, k - width)
        right = run_codes(code, step) if step < width else out
        n = max(0, len(code) - width - step + 1)
        pair = out[:n] * (int(right.max(initial=0)) + 1) + right[width : width + n]
        out, width = np.unique(pair, return_inverse=True)[1], width + step
    return out


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words of one row, with the index of its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_BASE)
        out += hashes[j : n + j]
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mix(out[at]), at
