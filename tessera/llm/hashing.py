"""Vectorised hashing of the tokens in Arrow string buffers, and winnowing of k-gram hashes.

No Python string is made: tokens are found as runs of marked bytes in the UTF-8 buffer, and a token's hash is the
difference of two prefix sums of a polynomial in an odd base modulo 2**64, mixed at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; bounds the memory of the prefix sums (eight bytes each).
SLICE_BYTES = 1 << 20
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def byte_table(chars: bytes, fold: bool = True, high: bool = False) -> np.ndarray:
    """256 entries: 0 for bytes outside tokens, else the byte a token byte counts as (A-Z folded to a-z)."""
    t = np.zeros(256, np.uint8)
    for c in chars:
        t[c] = c + 32 if fold and 65 <= c <= 90 else c
    if high:
        t[128:] = np.arange(128, 256)
    return t


WORD = bytes(range(48, 58)) + bytes(range(65, 91)) + b"_" + bytes(range(97, 123))

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below n (kept per worker, grown in powers of two)."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, np.uint64)
            down = np.full(size, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            _powers[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def tokens(buf: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the maximal runs of bytes that kinds maps to non-zero."""
    folded = kinds[buf]
    on = np.zeros(len(buf) + 2, np.int8)
    on[1:-1] = folded != 0
    edge = np.diff(on)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    up, down = _pow(len(buf) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(folded.astype(np.uint64) * up[: len(buf)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_STEP)
    return starts, ends, mix(h)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (one more than rows) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] else np.zeros(0, np.uint8)
    return data, at


def spaced_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """String buffers with a line feed after each row, so that no token reaches over a row's end."""
    data, at = string_buffers(column)
    n = len(at) - 1
    size = np.diff(at)
    out = np.full(int(size.sum()) + n, 10, np.uint8)
    keep = np.ones(len(out), bool)
    new = at - at[0] + np.arange(n + 1)
    keep[new[1:] - 1] = False
    out[keep] = data[at[0] : at[-1]]
    return out, new


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges of at most so many bytes each (a longer row stands alone)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def kgrams(h: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive tokens by their first; NONE where the k tokens are not of one row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        g = np.zeros(n, np.uint64)
        for j in range(k):
            g = g * np.uint64(_STEP) + h[j : j + n]
    g = mix(g)
    g[g == NONE] = 0
    g[rows[:n] != rows[k - 1 :]] = NONE
    return g


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least hash in each window of w k-grams of one row, the leftmost if several are least; of a row
    with fewer than w k-grams, the place of its least. What a row yields depends on no other row."""
    if not len(g):
        return np.zeros(0, np.int64)
    edge = np.diff(np.concatenate([[0], (g != NONE).astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    picked = []
    short = ends - starts < w
    if short.any():
        s, size = starts[short], (ends - starts)[short]
        first = np.append(0, np.cumsum(size)[:-1])
        at = np.repeat(s - first, size) + np.arange(size.sum())
        least = np.minimum.reduceat(g[at], first)
        hit = np.flatnonzero(g[at] == np.repeat(least, size))
        row = np.repeat(np.arange(len(s)), size)[hit]
        picked.append(at[hit[np.append(True, row[1:] != row[:-1])]])
    n = len(g) - w + 1
    if n > 0 and not short.all():
        best, at = g[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, w):
            less = g[j : j + n] < best
            best[less] = g[j : j + n][less]
            at[less] = j
        whole = np.zeros(len(g) + 1, np.int64)  # windows that lie within one row
        whole[starts[~short]] += 1
        whole[ends[~short] - w + 1] -= 1
        on = np.cumsum(whole)[:n] > 0
        picked.append((np.arange(n) + at)[on])
    return np.unique(np.concatenate(picked)) if picked else np.zeros(0, np.int64)
