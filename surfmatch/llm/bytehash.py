"""Vectorised hashing of words and byte windows over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
with np.errstate(over="ignore"):
    _inv = U(1)
    for _ in range(6):  # Newton's inverse of an odd number modulo 2**64
        _inv = _inv * (U(2) - BASE * _inv)
INVERSE = _inv
#: A random 64-bit value for each byte.
BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2**64, kept for the largest n so far."""
    have = _powers.get(int(base))
    if have is None or len(have) <= n:
        steps = np.full(max(n, 1 << 20) + 1, base, np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have[: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on each other."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any byte range by one subtraction (see span)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(BASE, len(data))[: len(data)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, equal for equal bytes wherever they stand; lengths are not mixed in."""
    return (sums[end] - sums[start]) * powers(INVERSE, len(sums))[start]


def batches_of_bytes(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of some bytes together; null as empty; a longer text alone."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, len(column))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word, in order."""
    full = ~BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = full[:-1]
    start = np.flatnonzero(full & (~before | first[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = full[1:]
    end = np.flatnonzero(full & (~after | first[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) of the k-word shingles, A-Z in lower case, sorted; a row of fewer words has them all as one."""
    data = LOWER[data]
    start, end, row = words(data, offsets)
    sums = prefix(data)
    word = mix(span(sums, start, end) + (end - start).astype(np.uint64))
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    at = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(len(word)) - at[row]
    out = np.zeros(len(word), np.uint64)
    for j in range(k):
        out[: len(word) - j] = mix(out[: len(word) - j] * U(31) + word[j:]) if j else word
    whole = place + k <= count[row]
    rows, hashes = row[whole], out[whole]
    for r in np.flatnonzero((count > 0) & (count < k)):
        h = U(count[r])
        for x in word[at[r] : at[r + 1]]:
            h = mix(np.array([h * U(33) + x]))[0]
        rows, hashes = np.append(rows, r), np.append(hashes, h)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]
