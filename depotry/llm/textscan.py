"""Vectorised scanning of whole texts held in Arrow buffers.

Words are runs of bytes other than ``[\\x20\\x09-\\x0D]``; for UTF-8 that equals the runs of
code points outside the same class. Hashes are 64-bit and lower-case A-Z only. Work goes in
segments of about ``SEGMENT`` bytes cut at white space, so memory does not follow the length
of a text; only the arrays of word hashes (8 bytes a word) do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_EXACT = np.arange(1, 257, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)

M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * M1
    x ^= x >> np.uint64(33)
    x *= M2
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 256), _BASE, np.uint64)
        p[0] = 1
        _POWERS = np.cumprod(p)
    return _POWERS


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def word_bounds(data: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of ``data``; a word never crosses a position in ``breaks``."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    if breaks is not None and len(breaks):
        b = breaks[(breaks > 0) & (breaks < len(data))]
        first[b] = inside[b]
        last[b - 1] = inside[b - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of each word, with A-Z lower-cased if ``fold``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    begin = np.concatenate(([0], np.cumsum(lens)[:-1]))
    rel = np.arange(int(lens.sum())) - np.repeat(begin, lens)
    values = (_LOWER if fold else _EXACT)[data[~_SPACE[data]]] * _powers(int(lens.max()))[rel]
    return mix64(np.add.reduceat(values, begin) + lens.astype(np.uint64))


def segments(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row + 1, first byte, last byte + 1); one text longer than SEGMENT comes in several."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + SEGMENT, "right")) - 1
        if j > i:
            yield i, min(j, n), int(offsets[i]), int(offsets[min(j, n)])
            i = min(j, n)
            continue
        a, end = int(offsets[i]), int(offsets[i + 1])
        while a < end:
            b = min(a + SEGMENT, end)
            if b < end:
                cut = np.flatnonzero(_SPACE[data[a:b]])
                while not len(cut) and b < end:  # one word longer than a segment
                    c = min(b + SEGMENT, end)
                    cut = np.flatnonzero(_SPACE[data[b:c]]) + (b - a)
                    b = c
                b = a + int(cut[-1]) + 1 if len(cut) else end
            yield i, i + 1, a, b
            a = b
        i += 1


def scan(column: pa.Array, fold: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, offsets of the rows in them) for runs of whole texts."""
    data, offsets = text_buffers(column)
    parts: list[np.ndarray] = []
    for i, j, a, b in segments(offsets, data):
        piece, at = data[a:b], offsets[i : j + 1] - a
        starts, ends = word_bounds(piece, at)
        hashes = hash_words(piece, starts, ends, fold)
        if j - i > 1 or (a == offsets[i] and b == offsets[j]):
            yield i, hashes, np.searchsorted(starts, at)
            continue
        parts.append(hashes)
        if b == offsets[j]:
            whole = np.concatenate(parts)
            parts = []
            yield i, whole, np.array([0, len(whole)])


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; shorter texts are one shingle, empty ones none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    salt = np.uint64(n)
    if len(words) < n:
        n, salt = len(words), np.uint64(len(words))
    out = np.full(len(words) - n + 1, salt, np.uint64)
    for k in range(n):
        out = (out ^ words[k : len(words) - n + 1 + k]) * _BASE
        out ^= out >> np.uint64(29)
    return np.unique(mix64(out))
