"""Words and word shingles of whole text columns as NumPy arrays.

A column of texts is looked at as one run of UTF-8 bytes with row offsets.
Words are the maximal runs without the ASCII blanks (space, tab to carriage
return) and A-Z count as a-z.  A word's hash is a polynomial in the values of
its bytes modulo 2**64, taken from one prefix sum over the run, so no Python
code runs per word.  Equal words have equal hashes; two different ones share
a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 19  # bytes hashed at once; longer only if a single word is
_rng = np.random.default_rng(20_240_607)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SEGMENT + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finaliser of a splitmix step)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def chunks(offsets: np.ndarray, limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of a single longer row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(n, max(low + 1, high))
        yield low, high
        low = high


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word."""
    inside = ~BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]  # rows that begin inside a word of the run
    first[at] = inside[at]
    last[at[at > 0] - 1] = inside[at[at > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hash of each slice; with the usual values of bytes, A-Z as a-z."""
    out = np.empty(len(starts), np.uint64)
    low, n = 0, len(starts)
    while low < n:
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + SEGMENT, "right")))
        a, b = int(starts[low]), int(ends[high - 1])
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[data[a:b]] * _power(_BASE, b - a), out=sums[1:])
        s, e = starts[low:high] - a, ends[low:high] - a
        out[low:high] = (sums[e] - sums[s]) * _power(_INVERSE, b - a + 1)[s] + (e - s).astype(np.uint64)
        low = high
    return mix(out)


def _follow(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0xD6E8FEB86659FD93) + word)


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of ``size`` words, in order.

    A row with fewer words, but one at least, has its whole sequence as its
    only shingle.  The hash depends on the number of words in the run.
    """
    n = len(hashes)
    per_row = np.bincount(row, minlength=n_rows) if n else np.zeros(n_rows, np.int64)
    h = hashes + np.uint64(size)
    if n < size:
        whole, at = np.zeros(0, np.uint64), np.zeros(0, row.dtype)
    else:
        whole = h[: n - size + 1]
        for k in range(1, size):
            whole = _follow(whole, hashes[k : n - size + 1 + k])
        same = row[: n - size + 1] == row[size - 1 :]
        whole, at = whole[same], row[: n - size + 1][same]
    begins = np.cumsum(per_row) - per_row
    parts, places = [whole], [at]
    for m in range(1, size):
        short = np.flatnonzero(per_row == m)
        if len(short):
            s = hashes[begins[short]] + np.uint64(m)
            for k in range(1, m):
                s = _follow(s, hashes[begins[short] + k])
            parts.append(s)
            places.append(short)
    if len(parts) == 1:
        return whole, at
    joined, places_all = np.concatenate(parts), np.concatenate(places)
    order = np.argsort(places_all, kind="stable")
    return joined[order], places_all[order]


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, sorted within the row."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[keep], row[keep]
    return h, row


def sequence_hashes(hashes: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's whole word sequence (0 and 0 without words)."""
    n = len(hashes)
    per_row = np.bincount(row, minlength=n_rows) if n else np.zeros(n_rows, np.int64)
    begins = np.cumsum(per_row) - per_row
    place = (np.arange(n) - begins[row]).astype(np.uint64)
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        terms = mix(hashes ^ mix(place * np.uint64(0xA24BAED4963EE407) + np.uint64(salt)))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        total = sums[begins + per_row] - sums[begins]
        out.append(np.where(per_row > 0, mix(total + per_row.astype(np.uint64)), np.uint64(0)))
    return out[0], out[1]
