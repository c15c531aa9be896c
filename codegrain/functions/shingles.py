"""Vectorised word and shingle hashing over Arrow text buffers.

A word is an unbroken run of ASCII letters, digits, ``_`` and characters from U+0080 up, case kept.
Every byte of such a character is a word byte in UTF-8, so words are found on the raw bytes of an
Arrow string array without decoding.  Texts are never cut: a buffer is worked through in segments
that end between words, and memory stays proportional to ``SEGMENT`` instead of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
HASH_BITS = 48
HASH_MASK = np.uint64((1 << HASH_BITS) - 1)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_A = np.uint64(0xD1342543DE82EF95)

_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[95] = True
_WORD[128:] = True

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, SEGMENT + 1)
        up, down = np.full(size, _P, np.uint64), np.full(size, _PINV, np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that low bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n+1) and bytes of a string array; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def word_hashes(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and row of every word, in reading order."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    is_word = _WORD[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        # as many whole words as fit into one segment, at least one
        stop = max(int(np.searchsorted(ends, starts[at] + SEGMENT, "right")), at + 1)
        base, end = int(starts[at]), int(ends[stop - 1])
        up, down = _pow(end - base + 1)
        total = np.zeros(end - base + 1, np.uint64)
        np.cumsum((raw[base:end].astype(np.uint64) + np.uint64(1)) * up[: end - base], out=total[1:])
        s, e = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        at = stop
    return out, np.searchsorted(offsets, starts, "right") - 1


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hash and row of every run of ``k`` consecutive words of one row."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = words[:n].copy()
    for j in range(1, k):
        acc = acc * _A + words[j : j + n]
    ok = rows[:n] == rows[k - 1 : k - 1 + n]
    return mix64(acc[ok]) & HASH_MASK, rows[:n][ok]


def row_chunks(offsets: np.ndarray, limit: int = SEGMENT, most: int = 1 << 15) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes and ``most`` rows each (a longer row stands alone)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), lo + most, n)
        yield lo, hi
        lo = hi


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk of rows: first row, words per row, set bounds per row, sorted distinct hashes."""
    offsets, raw = text_buffers(column)
    for lo, hi in row_chunks(offsets):
        words, rows = word_hashes(offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]])
        n_words = np.bincount(rows, minlength=hi - lo)
        h, r = shingle_hashes(words, rows, k)
        key = np.sort((r.astype(np.uint64) << np.uint64(HASH_BITS)) | h)
        if len(key):
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        bounds = np.searchsorted(key >> np.uint64(HASH_BITS), np.arange(hi - lo + 1, dtype=np.uint64))
        yield lo, n_words, bounds, key & HASH_MASK
