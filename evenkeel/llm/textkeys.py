"""Vectorised hashing of words and byte strings over Arrow batches of texts (numpy, in tasks).

Strings are hashed by prefix sums: sum over k of table[byte_k] * P^k modulo 2^64, shifted to the
string's start by the inverse power and mixed.  Equal byte strings get equal hashes wherever they
stand; all work is linear in the bytes and no Python loop runs over words or positions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
# odd factors without a pattern, one for each place in a shingle (and in a shorter text)
_PLACES = mix(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]  # A-Z as a-z
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Powers:
    """P^k and P^-k, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 4096)
            self.up, self.down = _powers(_P, size), _powers(pow(_P, -1, 1 << 64), size)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins (one more entry: the end).
    A null text has no bytes."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(at):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]
    return raw, at - at[0]


def slices(begins: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of texts of about `most` bytes; a longer text stands alone."""
    n, i = len(begins) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(begins, begins[i] + most, side="right")) - 1)
        yield i, j
        i = j


def prefix_sums(raw: np.ndarray, powers: Powers, table: np.ndarray = _BYTES) -> np.ndarray:
    """One entry more than bytes; hash of [i, j) is string_hash(sums, i, j)."""
    powers.grow(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(table[raw] * powers.up[: len(raw)], out=sums[1:])
    return sums


def string_hash(sums: np.ndarray, powers: Powers, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((sums[j] - sums[i]) * powers.down[i])


def words(raw: np.ndarray, begins: np.ndarray, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the first word of each text (one more entry: all words)."""
    solid = np.zeros(len(raw) + 2, dtype=bool)
    solid[1:-1] = ~gap[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[begins] = True
    here, before = solid[1:], solid[:-1]
    first = np.flatnonzero(here & (~before | edge))
    last = np.flatnonzero(before & (~here | edge))
    return first, last, np.searchsorted(first, begins)


def shingle_sets(texts: pa.Array, powers: Powers, width: int = 5):
    """Per text its sorted distinct shingle hashes (uint64): of `width` words each, or of all words
    when there are fewer; none without words.  A-Z count as a-z."""
    raw_all, begins_all = text_bytes(texts)
    for i, j in slices(begins_all):
        begins = begins_all[i : j + 1] - begins_all[i]
        raw = raw_all[begins_all[i] : begins_all[j]]
        sums = prefix_sums(raw, powers, _FOLDED)
        first, last, at = words(raw, begins)
        h = string_hash(sums, powers, first, last) + np.uint64(1)
        with np.errstate(over="ignore"):
            if len(h) >= width:
                n = len(h) - width + 1
                s = np.zeros(n, dtype=np.uint64)
                for k in range(width):
                    s += h[k : k + n] * _PLACES[k]
                s = mix(s)
            for d in range(j - i):
                a, b = int(at[d]), int(at[d + 1])
                if b - a >= width:
                    yield np.unique(s[a : b - width + 1])
                elif b > a:
                    part = h[a:b] * _PLACES[width : width + b - a]
                    yield mix(part.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
                else:
                    yield np.zeros(0, dtype=np.uint64)
