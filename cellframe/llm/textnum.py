"""Vectorised word and shingle hashing of UTF-8 text in numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    """_BASE ** 0 ... _BASE ** (n - 1), modulo 2 ** 64."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    out[1:] = _BASE
    return np.multiply.accumulate(out)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words (runs without the six white-space bytes)."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_BLANK[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


#: 256 random odd-free 64-bit codes, one a byte value, so that word hashes are polynomials over large coefficients.
_CODE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each span; equal bytes give equal hashes wherever they stand.

    Spans must be in order and must not overlap.
    """
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    length = end - start
    most = int(length.max())
    # position within the span, counted from its start
    total = int(length.sum())
    first = np.cumsum(length) - length
    within = np.arange(total) - np.repeat(first, length)
    power = _powers(most)
    flat = data[np.repeat(start, length) + within]
    terms = _CODE[flat] * power[within]
    sums = np.add.reduceat(terms, first)
    return mix(sums ^ (length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of `size` consecutive word hashes; the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    k = min(size, len(words))
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + words[i : len(words) - k + 1 + i] + np.uint64(k))
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return _UPPER[data]


def doc_bytes(batch_column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, offsets, is null) of an Arrow string or binary column; nulls have no bytes."""
    import pyarrow as pa

    col = batch_column
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    null = np.asarray(col.is_null())
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    return data, offs, null
