"""Sampled suffixes of byte texts: every window of a length is held by one of them.

A window of ``length`` bytes contains ``length - k + 1`` strings of k bytes; the one
of least hash (leftmost of equals) is its anchor. Equal windows have their anchors
at equal places, so windows can be compared anchor by anchor. Neighbouring windows
mostly share their anchor, which gives about two anchors for each length - k bytes.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from surfmatch.llm.bytehash import U, mix, prefix, span


class Anchors(NamedTuple):
    """Runs of neighbouring windows that share an anchor: one suffix each."""

    key: np.ndarray  # hash of the k bytes at the anchor
    body: np.ndarray  # hash of all bytes the run's windows cover, and of where the anchor lies in them
    row: np.ndarray
    lo: np.ndarray  # first window start, in its text
    n: np.ndarray  # number of windows
    ahead: np.ndarray  # from the first window's start to the anchor


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours."""
    width, m = 1, v
    while 2 * width <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = w - width
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def window_anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> Anchors:
    """Anchors of all windows inside the texts that offsets cut data into."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return Anchors(none.astype(U), none.astype(U), none, none, none, none)
    sums = prefix(data)
    at = np.arange(len(data) - k + 1)
    key = mix(span(sums, at, at + k))
    bits = U(max(20, len(data).bit_length()))
    least = sliding_least((key >> bits) << bits | at.astype(U), length - k + 1)
    anchor = (least & ((U(1) << bits) - U(1))).astype(np.int64)
    start = np.arange(len(anchor))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    inside = start + length <= offsets[row + 1]
    start, anchor, row = start[inside], anchor[inside], row[inside]
    if not len(start):
        return Anchors(none.astype(U), none.astype(U), none, none, none, none)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, a = start[first], start[last], anchor[first]
    body = mix(span(sums, lo, hi + length) + mix((hi - lo).astype(U) * U(4096) + (a - lo).astype(U)))
    return Anchors(key[a], body, row[first], lo - offsets[row[first]], hi - lo + 1, a - lo)


def blocks(sums: np.ndarray, lo: np.ndarray, n: np.ndarray, ahead: np.ndarray, length: int, step: int) -> Anchors:
    """Runs of windows cut into blocks of up to step neighbours, at fixed distances from the anchor.

    key is the hash of the bytes that all windows of a block's place share, body of
    all they cover; row tells which run a block comes from.
    """
    first, last = ahead - (n - 1), ahead  # distances from window start to anchor, of the last and the first window
    low_, high = first // step, last // step
    count = high - low_ + 1
    row = np.repeat(np.arange(len(lo)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + low_[row]
    far, near = np.minimum((place + 1) * step - 1, last[row]), np.maximum(place * step, first[row])
    anchor = lo[row] + ahead[row]
    start, size = anchor - far, far - near + 1
    # what the whole block would share, were it not cut off at the run's ends, lies inside every one of its windows
    inner, outer = anchor - place * step, anchor - ((place + 1) * step - 1) + length
    tag = mix((place + 4096).astype(U))
    key = mix(span(sums, inner, outer) + tag)
    body = mix(span(sums, start, start + size - 1 + length) + mix(size.astype(U) * U(4096) + (anchor - start).astype(U)))
    return Anchors(key, body, row, start, size, anchor - start)
