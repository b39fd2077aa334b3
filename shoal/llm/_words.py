"""Hashes of the words of many texts at once, on their UTF-8 bytes.

Words are runs of bytes other than ASCII white space. A word's hash is a sum of
random numbers for its bytes, each times a power for its place: one running sum
over a stretch of bytes gives the hashes of all words in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .perfect_hash import mix

#: Bytes of text looked at together, and hashed together, as fits in a cache; longer ones are cut at white space.
STRETCH, CHUNK = 1 << 18, 1 << 15
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_EXACT = mix(np.arange(256, dtype=np.uint64), 11)
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]
_SECOND = mix(np.arange(256, dtype=np.uint64), 29)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, b, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Hash, second hash (if asked for), first byte and end of every word, and for each text the bounds of its words."""

    hashes: np.ndarray
    second: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def _stretch(data: np.ndarray, firsts: np.ndarray, tables: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    n = len(data)
    blank = SPACE[data]
    opens = blank[:-1].copy()
    opens[firsts[(firsts > 0) & (firsts < n)] - 1] = True
    word = ~blank
    starts = np.flatnonzero(np.concatenate((word[:1], word[1:] & opens)))
    opens = blank[1:].copy()
    opens[firsts[(firsts > 0) & (firsts < n)] - 1] = True
    ends = np.flatnonzero(np.concatenate((word[:-1] & opens, word[-1:]))) + 1
    up, down = powers(n)
    hashes = []
    for table in tables:
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * up, out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * down[starts], 5))
    return hashes, starts, ends


def words_of(data: np.ndarray, offsets: np.ndarray, fold: bool = True, twice: bool = False) -> Words:
    """The words of the texts data[offsets[i]:offsets[i + 1]]; fold lower-cases A-Z, twice gives second hashes."""
    tables, found, at = [_FOLDED if fold else _EXACT, *([_SECOND] if twice else [])], [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        if end < len(data):
            while end < len(data) and not SPACE[data[end]]:
                gap = np.flatnonzero(SPACE[data[end : end + 256]])
                end = end + int(gap[0]) if len(gap) else min(len(data), end + 256)
        h, s, e = _stretch(data[at:end], offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at, tables)
        found.append((h[0], h[-1], s + at, e + at))
        at = end
    hashes, second, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Words(hashes, second, starts, ends, np.searchsorted(starts, offsets))


def stretches(column: pa.Array, size: int = STRETCH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets) of consecutive texts of about size bytes; nulls are empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
