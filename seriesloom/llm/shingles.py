"""Word shingles of whole texts, from the bytes of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each text begins (and the last ends)."""
    filled = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = filled.buffers()
    at = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def word_hashes(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased), and the first word of each text (and the end)."""
    word = ~_SPACE[body]
    begin = word.copy()
    if len(body):
        begin[1:] &= ~word[:-1]
        inner = at[:-1][at[:-1] < len(body)]
        begin[inner] = word[inner]
    starts = np.flatnonzero(begin)
    first = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    letters = np.flatnonzero(word)
    of_word = np.cumsum(begin)[letters] - 1
    place = letters - starts[of_word]
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, dtype=np.uint64))
    values = _BYTE[_LOWER[body[letters]]] * powers[place]
    compact = np.searchsorted(letters, starts)
    sums = np.add.reduceat(values, compact)
    lengths = np.diff(np.append(compact, len(letters))).astype(np.uint64)
    return scramble(sums + lengths * _STEP), first


def shingle_sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle as a whole."""
    body, at = text_bytes(column)
    words, first = word_hashes(body, at)
    rolled = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        rolled = rolled * _STEP + words[k : k + len(rolled)]
    rolled = scramble(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    whole = whole * _BASE + w
            out.append(scramble(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
