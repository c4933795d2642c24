"""Vectorised hashing of words and shingles over the UTF-8 bytes of Arrow text columns.

All sums are taken modulo 2**64. A word's hash is a polynomial in a random table of its bytes, a shingle's hash a
random linear form of its word hashes; both end in a mixing step, so equal words give equal hashes everywhere and
different ones collide with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(0, 2**64, 256, dtype=U)
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(int(BASE), -1, 2**64))
LANES = _rng.integers(0, 2**64, 64, dtype=U) | U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
WORD_BYTE = BYTE[LOWER]
WORD_BYTE[SPACE] = 0

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), kept and grown between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.ones(size, U)
        have[1:] = base
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column one after another, and n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    if column.null_count:  # a null may cover bytes
        column = column.fill_null(b"")
        return utf8(column)
    return data, offsets


def slices(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about ``size`` bytes, so that temporary arrays stay small; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1))
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts data[offsets[i]:offsets[i+1]], A-Z in lower case, and how many each text has."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    part = data[lo:hi]
    if not len(part):
        return np.zeros(0, U), np.zeros(len(offsets) - 1, np.int64)
    solid = ~SPACE[part]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = (offsets[:-1] - lo)[offsets[:-1] < offsets[1:]]
    begins[first] = solid[first]
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, offsets - lo))
    if not len(starts):
        return np.zeros(0, U), counts
    with np.errstate(over="ignore"):
        terms = WORD_BYTE[part]
        terms *= powers(BASE, len(part))
        sums = np.add.reduceat(terms, starts) * powers(BASE_INV, len(part))[starts]
    return mix(sums), counts


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words of one text; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        if n < width:
            return mix((words * LANES[:n]).sum(keepdims=True) + U(n))
        out = words[: n - width + 1] * LANES[0]
        for k in range(1, width):
            out += words[k : n - width + 1 + k] * LANES[k]
    return mix(out)


def text_shingles(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text of the column its sorted distinct shingle hashes."""
    data, offsets = utf8(column)
    for i, j in slices(offsets):
        words, counts = word_hashes(data, offsets[i : j + 1])
        at = 0
        for n in counts.tolist():
            yield np.unique(shingle_hashes(words[at : at + n], width))
            at += n
