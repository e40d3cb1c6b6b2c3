"""Vectorised scanning of UTF-8 text that lies in Arrow buffers.

Nothing here makes a Python string of a document: whole batches are handled as
one byte array with offsets, in chunks of bounded size.
"""

from __future__ import annotations

import ctypes
import gc
import sys

import numpy as np
import pyarrow as pa

CHUNK = 1_000_000
U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a bijection on uint64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def byte_keys(seed: int = 1) -> np.ndarray:
    """A random odd 64-bit number for each byte value."""
    return mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95) + U(seed)) | U(1)


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=U)
    have, step = 1, base & _M
    while have < n:
        m = min(have, n - have)
        out[have : have + m] = out[:m] * U(step)
        have, step = have + m, (step * step) & _M
    return out


def _scale(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r**i and r**-i for i < n; a process keeps one pair of tables, of a chunk's size."""
    kept = sys.__dict__.setdefault("_lodeworks_powers", [])
    if not kept:
        kept[:] = powers(CHUNK + 1, _R), powers(CHUNK + 1, pow(_R, -1, 1 << 64))
    if n <= CHUNK + 1:
        return kept[0], kept[1]
    return powers(n, _R), powers(n, pow(_R, -1, 1 << 64))


def frugal(work):
    """A function over a partition's batches that gives its memory back at the end:
    workers live on and wait for their next task."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Return the memory that is free to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


class Roller:
    """Sums of key[byte] * r**i, from which the hash of any span comes in O(1)."""

    def __init__(self, seed: int = 1) -> None:
        self.keys = byte_keys(seed)

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, premul: np.ndarray | None = None) -> np.ndarray:
        """The hash of data[start:end] for each span; data holds bytes, or 64-bit symbols as premul."""
        n = len(data) if premul is None else len(premul)
        up, down = _scale(n + 1)
        total = np.zeros(n + 1, dtype=U)
        np.cumsum((self.keys[data] if premul is None else premul) * up[:n], out=total[1:])
        return mix((total[end] - total[start]) * down[start])


def text_column(batch: pa.RecordBatch | pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its offsets (int64, one more than rows); null counts as empty."""
    col = batch.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK):
    """Cut rows into runs of about `limit` bytes; a longer document is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the Latin-1 letters in UTF-8; other letters stay as they are."""
    out = _LOWER[data]
    if len(out) > 1:
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][up] += 32
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut at document borders."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(n, dtype=bool)
    edge[0] = True
    edge[1:] = ~inside[:-1]
    edge[offsets[(offsets >= 0) & (offsets < n)]] = True
    starts = np.flatnonzero(edge & inside)
    stop = np.empty(n, dtype=bool)
    stop[-1] = True
    stop[:-1] = ~inside[1:]
    inner = offsets[(offsets > 0) & (offsets <= n)]
    stop[inner - 1] = True
    return starts, np.flatnonzero(stop & inside) + 1


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased runs of letters and digits: bytes, starts, ends. offsets are relative to data."""
    low = lowered(data)
    return (low, *runs(_WORD[data], offsets))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs without ASCII white space, byte for byte: starts, ends. Scripts that write
    no spaces have a word for each character: those from U+3000 to U+9FFF stand alone."""
    s, e = runs(~_SPACE[data], offsets)
    lead = np.flatnonzero((data >= 0xE3) & (data <= 0xE9))
    if len(lead) and len(s):
        cut = np.unique(np.concatenate([lead, lead + 3]))
        at = np.maximum(np.searchsorted(s, cut, side="right") - 1, 0)
        cut = cut[(cut > s[at]) & (cut < e[at])]
        s, e = np.sort(np.concatenate([s, cut])), np.sort(np.concatenate([e, cut]))
    return s, e
