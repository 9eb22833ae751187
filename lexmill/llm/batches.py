"""Whole texts of an Arrow batch as NumPy arrays: words, hashes and distinct shingles without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are worked on at once (a longer single text is taken whole).
CHUNK = 1 << 18
_rng = np.random.default_rng(20_240_501)
#: A random 64-bit value for every byte, with A-Z as a-z.
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: What stands between words of ASCII letters, digits and all that isn't ASCII.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_R = U(0x9E3779B97F4A7C15)
_R_INV = U(pow(int(_R), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK * 2), base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 8 * CHUNK:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) in pieces of about CHUNK bytes; nulls are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word in order, number of words before each row and in all); ``gap``: which bytes are no part of a word."""
    if not len(raw):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    inside = ~gap[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    run = np.zeros(len(raw) + 1, U)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[raw] * powers(_R, len(raw)), out=run[1:])
    return mix((run[e + 1] - run[s]) * powers(_R_INV, len(raw))[s] + (e - s).astype(U)), np.searchsorted(s, offsets)


def shingles(h: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingle hashes by row, sorted in each, and the rows' offsets.

    A row of fewer, but not no, words has its whole sequence as one shingle.
    """
    count = np.diff(before)
    windows = np.maximum(count - n + 1, (count > 0).astype(np.int64))
    row = np.repeat(np.arange(len(count)), windows)
    start = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows) + before[:-1][row]
    s = np.zeros(len(row), U)
    size = np.minimum(count, n)[row]
    for k in range(n):
        part = np.where(k < size, h[np.minimum(start + k, max(len(h) - 1, 0))] if len(h) else U(0), U(0))
        s = (s ^ part) * U(0x9FB21C651E98DF25) + U(k + 1)
        s ^= s >> U(29)
    s = mix(s)
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    s, row = s[fresh], row[fresh]
    return s, np.searchsorted(row, np.arange(len(count) + 1))


def squeeze(a: np.ndarray) -> bytes:
    """An integer array as compressed byte planes."""
    import zstandard

    width = a.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def unsqueeze(data: bytes, dtype: type) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(dtype).ravel()


def deltas(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys as squeezed differences."""
    return squeeze(np.diff(keys, prepend=U(0)))


def undelta(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64), dtype=np.uint64)
