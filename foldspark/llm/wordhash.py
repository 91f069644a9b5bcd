"""Vectorised word and shingle hashes over Arrow string columns.

A word is a run of bytes outside space and 0x09-0x0D after lower-casing A-Z; a shingle is ``k`` words in a row. Word
hashes are differences of one prefix sum of a 64-bit polynomial, so a whole slice of texts is hashed by a few numpy
passes. Slices hold about ``SLICE`` bytes (one text at least), which bounds the memory of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _U(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U))


def _power(n: int, base: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE + 1), base, _U)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= 4 * SLICE:
            _powers[key] = have
    return have[:n]


def ranges_hash(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of ranges of ``values``: differences of one prefix sum, set to the same power, mixed with the size."""
    n = len(values)
    sums = np.empty(n + 1, _U)
    sums[0] = 0
    np.cumsum(values * _power(n, _BASE), out=sums[1:])
    return mix((sums[starts + sizes] - sums[starts]) * _power(n, _INVERSE)[starts] + sizes.astype(_U) * _STEP)


@dataclass
class Words:
    """Words of several texts: byte ranges in ``data``, hashes, and the first word of every text (one entry more)."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for runs of rows of about ``limit`` bytes."""
    data, offsets = text_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1), row + 20_000)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(0, _U), np.zeros(len(offsets), np.int64))
    low = _LOWER[data]
    word = ~_SPACE[low]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = offsets[:-1][np.diff(offsets) > 0]
    first[full] = word[full]
    full = offsets[1:][np.diff(offsets) > 0] - 1
    last[full] = word[full]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = ranges_hash(_BYTE[low], starts, ends - starts)
    return Words(data, offsets, starts, ends, hashes, np.searchsorted(starts, offsets))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles in order, and their offsets by text. Fewer words: the whole sequence as one."""
    count = np.diff(w.rows)
    many = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    at = np.zeros(len(many) + 1, np.int64)
    np.cumsum(many, out=at[1:])
    n = len(w.hashes)
    padded = np.concatenate([w.hashes, np.zeros(k, _U)])
    sums, factor = np.zeros(n, _U), 1
    for j in range(k):
        sums += padded[j : j + n] * _U(factor)
        factor = factor * int(_STEP) % (1 << 64)
    for row in np.flatnonzero((count > 0) & (count < k)):
        factor, total = 1, int(count[row])
        for h in w.hashes[w.rows[row] : w.rows[row + 1]]:
            total = (total + int(h) * factor) % (1 << 64)
            factor = factor * int(_STEP) % (1 << 64)
        sums[w.rows[row]] = total
    picked = np.repeat(w.rows[:-1] - at[:-1], many) + np.arange(at[-1])
    return mix(sums[picked]), at


def shingle_sets(column: pa.Array, k: int, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, sorted distinct shingles of each text one after another, offsets)."""
    for row, end, data, offsets in slices(column, limit):
        values, at = shingles(words(data, offsets), k)
        sets = [np.unique(values[at[i] : at[i + 1]]) for i in range(end - row)]
        bounds = np.zeros(end - row + 1, np.int64)
        np.cumsum([len(s) for s in sets], out=bounds[1:])
        yield row, end, np.concatenate(sets), bounds


def minhash(values: np.ndarray, at: np.ndarray, samples: int) -> np.ndarray:
    """(samples, texts) smallest values under ``samples`` hash functions; every text must have a value."""
    x = (values >> _U(32)).astype(np.uint32)
    seeds = mix(np.arange(1, samples + 1, dtype=_U))
    factor, shift = (seeds >> _U(32)).astype(np.uint32) | np.uint32(1), seeds.astype(np.uint32)
    out = np.empty((samples, len(at) - 1), np.uint32)
    for lo in range(0, len(at) - 1, 64):
        hi = min(lo + 64, len(at) - 1)
        part = x[at[lo] : at[hi]]
        held = np.empty_like(part)
        begins = at[lo:hi] - at[lo]
        for i in range(samples):
            np.multiply(part, factor[i], out=held)
            np.bitwise_xor(held, shift[i], out=held)
            np.minimum.reduceat(held, begins, out=out[i, lo:hi])
    return out


def fold(rows: np.ndarray) -> np.ndarray:
    """One 64-bit hash of every column of ``rows``."""
    out = np.full(rows.shape[1], len(rows), _U)
    for row in rows:
        out = out * _STEP + row.astype(_U)
    return mix(out)
