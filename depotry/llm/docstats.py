"""Counts of a whole text that rules and classifiers read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from depotry.llm.textscan import scan, segments, text_buffers

WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "top_word", "n_upper", "n_digits", "n_marks", "n_bars", "n_wide", "n_short_lines", "n_closed", "n_shouts")

# The symbols that the rules count, and what closes a sentence.
SYMBOLS = b"#*$%&|<>"
CLOSERS = (b".", b"!", b"?", b'"', b":", b";")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CLASSES = {
    "n_symbols": _class(SYMBOLS),
    "n_upper": _class(bytes(range(65, 91))),
    "n_digits": _class(bytes(range(48, 58))),
    "n_marks": _class(b"!\"'(),-./:;?[]_{}"),
    "n_bars": _class(b"|"),
    "n_wide": _class(bytes(range(0xC2, 0xF5))),
    "n_shouts": _class(b"!"),
}
_START = np.ones(256, bool)  # bytes that begin a code point and are no white space
_START[0x80:0xC0] = False
_START[[9, 10, 11, 12, 13, 32]] = False


def repeat_words(words: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that the text holds at least twice, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = (mixed ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    _, back, times = np.unique(mixed, return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(times[back] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def text_counts(column: pa.Array) -> np.ndarray:
    """One row of COUNTS for each text; a null counts as empty."""
    data, offsets = text_buffers(column)
    out = np.zeros((len(offsets) - 1, len(COUNTS)), np.int64)
    index = {c: i for i, c in enumerate(COUNTS)}
    for i, j, a, b in segments(offsets, data):
        piece, at = data[a:b], np.clip(offsets[i : j + 1] - a, 0, b - a)
        for name, table in (*_CLASSES.items(), ("word_chars", _START)):
            sums = np.concatenate(([0], np.cumsum(table[piece], dtype=np.int64)))
            out[i:j, index[name]] += np.diff(sums[at])
    for i, words, at in scan(column, fold=False):
        for r, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True), i):
            own = words[x:y]
            if len(own):
                times = np.unique(own, return_counts=True)[1]
                out[r, [index["n_words"], index["n_distinct"], index["top_word"], index["n_repeat_words"]]] = len(own), len(times), times.max(), repeat_words(own)
    for r in range(len(offsets) - 1):
        lines = [x for x in data[offsets[r] : offsets[r + 1]].tobytes().split(b"\n") if x and not x.isspace()]
        short = sum(len(x) < 40 for x in lines)
        out[r, [index["n_lines"], index["n_dup_lines"], index["n_short_lines"], index["n_closed"]]] = len(lines), len(lines) - len(set(lines)), short, sum(x.rstrip().endswith(CLOSERS) for x in lines)
    return out
