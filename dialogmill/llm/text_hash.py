"""Vectorised word and shingle hashing of Arrow string columns (helpers that run inside tasks).

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z count as a-z. Every hash is
64 bits wide and depends on the word's bytes alone, never on its place, batch or partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts handled together; a longer text is a chunk of its own
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next chunk of the task."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        run = np.full(max(n, CHUNK_BYTES), base, np.uint64)
        run[0] = 1
        np.multiply.accumulate(run, out=run)
        have = run
        if n <= CHUNK_BYTES:  # those of a longer text aren't kept
            _powers[base] = have
    return have[:n]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base, or of its inverse, modulo 2**64."""
    return _power(_BASE_INV if inverse else _BASE, n)


def text_chunks(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into them) for runs of rows of about ``size`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1)
        yield row, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of every word of a chunk; a row's end ends a word."""
    solid = ~_WS[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True  # a row's first byte, and the end of the chunk
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last)


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, fold: bool = True) -> np.ndarray:
    """Hash of the bytes begin..end of each span; ``fold``: with A-Z as a-z."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    total = _BYTE[_LOWER[raw] if fold else raw]
    total *= _power(_BASE, len(raw))
    np.cumsum(total, out=total)
    before = np.where(begin > 0, total[begin - 1], np.uint64(0))
    return mix((total[end] - before) * _power(_BASE_INV, len(raw))[begin])


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a chunk in order, and each row's bounds among them."""
    begin, end = word_spans(raw, off)
    return span_hashes(raw, begin, end), np.searchsorted(begin, off)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words; for fewer words, one of the whole run; for none, none."""
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xE7037ED1A0B428DB) + words[k : len(words) - width + 1 + k]
    return mix(out)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row, null and empty ones included."""
    for row, raw, off in text_chunks(texts):
        words, bound = word_hashes(raw, off)
        for k in range(len(off) - 1):
            yield row + k, np.unique(shingle_hashes(words[bound[k] : bound[k + 1]], width))
