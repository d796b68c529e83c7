"""Vectorised words, lines and rolling hashes of Arrow text columns, a bounded slice of bytes at a time.

Hashes are 64 bits: a polynomial over random byte values (words, lines) and over word hashes (k-grams), finished by a
bijective mix. They depend on the bytes only, so every executor computes the same ones.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; a longer document is handled alone, whole.
SLICE_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = np.uint64(0xD1342543DE82EF95)
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between ASCII white space, and of words between anything ASCII that is neither letter nor digit.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


class Words(NamedTuple):
    """Words of a slice of documents; those of document i are at first[i] to first[i + 1]."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _powers[:] = [
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b)]), dtype=np.uint64) for b in (_BASE, _BACK)
        ]
    return _powers[0][:n], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span."""
    total = np.zeros(len(data) + 1, np.uint64)
    forward, back = powers(len(data) + 1)
    np.cumsum(_BYTES[data] * forward[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of a class, never across documents: starts, ends, first run of each document."""
    flags = inside[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = True, True
    edge[1:-1] = ~flags[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    edge[cuts] = True
    starts = np.flatnonzero(flags & edge[:-1])
    edge[1:-1] = ~flags[1:]
    edge[cuts] = True
    ends = np.flatnonzero(flags & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Words of lower-cased text (A-Z only) with their hashes."""
    data = LOWER[data]
    starts, ends, first = spans(data, offsets, inside)
    return Words(span_hashes(data, starts, ends), starts, ends, first)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive values; the last k - 1 values start none."""
    n = max(0, len(hashes) - k + 1)
    out, power = np.full(n, np.uint64(k)), np.uint64(1)
    for j in range(k):
        with np.errstate(over="ignore"):
            power = power * _GRAM
        out += hashes[j : j + n] * power
    return mix(out)


def shingle_sets(found: Words, k: int) -> Iterator[np.ndarray]:
    """For each document its sorted distinct k-gram hashes; with fewer than k words the whole sequence is one shingle,
    without words there is none."""
    grams = gram_hashes(found.hashes, k)
    for a, b in itertools.pairwise(found.first.tolist()):
        if b - a >= k:
            own = np.sort(grams[a : b - k + 1])
            new = np.empty(len(own), bool)
            new[0] = True
            np.not_equal(own[1:], own[:-1], out=new[1:])
            yield own[new]
        else:
            yield gram_hashes(found.hashes[a:b], b - a) if b > a else found.hashes[:0]


def raw_sequences(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each run of 64-bit values, not mixed: hashes of parts add up to that of the whole."""
    total = np.zeros(len(values) + 1, np.uint64)
    forward, back = powers(len(values) + 1)
    np.cumsum(values * forward[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * back[starts]


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans between line feeds: starts, ends, first line of each document; an empty text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    first = np.concatenate([[0], np.cumsum(np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = False
    starts[first[:-1]], starts[inner] = offsets[:-1], breaks + 1
    inner[:] = True
    inner[first[1:] - 1] = False
    ends[first[1:] - 1], ends[inner] = offsets[1:], breaks
    return starts, ends, first
