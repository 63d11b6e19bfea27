"""Vectorised words and n-grams over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import strings, utf8

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads a 64-bit value over all bits."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without ASCII white space, in lower case) and the offsets by text."""
    column = strings(column)
    data, offsets = utf8(strings(pc.utf8_lower(column)) if lower else column)
    gap = _SPACE[data]
    first = ~gap
    if len(data):
        first[1:] &= gap[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[heads] = ~gap[heads]
    start = np.flatnonzero(first)
    ends = np.sort(np.concatenate([np.flatnonzero(gap), offsets[1:]]))
    length = ends[np.searchsorted(ends, start, side="right")] - start if len(start) else start
    h = np.full(len(start), 0x9E3779B97F4A7C15, np.uint64)
    live, k = np.arange(len(start)), 0
    while len(live):
        h[live] = h[live] * np.uint64(0x100000001B3) + data[start[live] + k] + np.uint64(1)
        k += 1
        live = live[length[live] > k]
    return mix(h), np.searchsorted(start, offsets)


def shingles(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of `width` successive words, sorted within each text, and their offsets.

    A text of fewer words than `width` has one shingle of all its words; one without words has none.
    """
    words, offsets = word_hashes(column)
    n = np.diff(offsets)
    made = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    out_at = np.concatenate([[0], np.cumsum(made)])
    doc = np.repeat(np.arange(len(n)), made)
    at = np.arange(out_at[-1]) - out_at[doc] + offsets[doc]
    left = offsets[doc + 1] - at
    h = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.where(left > k, padded[at + k], np.uint64(k + 1)))
    order = np.lexsort((h, doc)) if len(h) else np.empty(0, np.int64)
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(n)))]).astype(np.int64)


def ngram_counts(column: pa.Array, dims: int, orders: tuple[int, ...], letters_only: bool) -> np.ndarray:
    """Counts of byte n-grams of whole texts, hashed to `dims` columns for each order. [texts, dims * orders]

    letters_only: ASCII bytes that aren't letters count as one space, so digits and marks tell nothing.
    """
    column = strings(pc.utf8_lower(strings(column)))
    data, offsets = utf8(column)
    n = len(column)
    if letters_only:
        fold = np.arange(256, dtype=np.uint8)
        fold[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]
        data = fold[data]
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    out = np.zeros((n, dims * len(orders)), np.float32)
    for j, order in enumerate(orders):
        m = len(data) - order + 1
        if m <= 0:
            continue
        key = np.zeros(m, np.uint32)
        for k in range(order):
            key = key * np.uint32(257) + data[k : k + m]
        key = (key * np.uint32(2654435761)) >> np.uint32(8)
        same = doc[:m] == doc[order - 1 :]
        at = doc[:m][same] * dims + (key[same] % np.uint32(dims))
        out[:, j * dims : (j + 1) * dims] = np.bincount(at, minlength=n * dims).reshape(n, dims)
    return out
