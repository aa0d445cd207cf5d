"""Vectorised word scanning and hashing over Arrow string buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; all separators are single ASCII bytes, so scanning UTF-8
bytes finds the same words as scanning characters. Work goes on in chunks of about CHUNK bytes of whole texts, so
memory is bounded by the chunk and the longest single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

CHUNK = 1 << 20
_U = np.uint64
_IS_SEP = np.zeros(256, bool)
_IS_SEP[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other and the offsets of each; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, bytes, offsets) of runs of whole texts."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK, side="right")) - 1)
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text index of each word."""
    sep = _IS_SEP[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = edge.copy()
    before[1:] |= sep
    start = np.flatnonzero(~sep & before[:-1])
    stop = edge[1:].copy()
    stop[:-1] |= sep[1:]
    end = np.flatnonzero(~sep & stop) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        forth, back = np.empty(size, np.uint64), np.empty(size, np.uint64)
        for out, base in ((forth, _P), (back, pow(_P, -1, 1 << 64))):
            out[0], have, step = 1, 1, base
            while have < size:
                out[have : 2 * have] = out[:have] * _U(step)
                step, have = step * step % (1 << 64), 2 * have
        _powers[size] = forth, back
    return _powers[size]


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes; lower: as if A-Z were a-z."""
    if not len(start):
        return np.zeros(0, np.uint64)
    forth, back = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * forth[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * _U(_Q))


def windows(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one text, and the index of each one's first word."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - k + 1
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total *= _U(_Q)
        total += h[j : j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(total[at]), at


def pack(values: np.ndarray) -> bytes:
    """Integers of one width, byte plane by byte plane, compressed."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()


def released(f: Callable) -> Callable:
    """f over Arrow batches; afterwards freed memory goes back to the system, as Python workers live on between tasks."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            _powers.clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run
