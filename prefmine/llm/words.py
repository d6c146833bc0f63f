"""Words and word shingles of whole Arrow batches of texts, hashed without a Python loop over words.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Texts are taken in slices of about
half a megabyte (a longer text is a slice of its own), so temporary arrays stay small whatever the
batch holds. Hashes are 64-bit: a polynomial over the bytes, then a finaliser. Two different words
share a hash with a chance of about 2**-64; hashes stand for words and shingles throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
SHINGLE = 5
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; grows to the longest slice met."""
    if len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slice(NamedTuple):
    """Documents ``first`` to ``first + n`` of a batch: their bytes and the offsets of each."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """One entry per word, in text order: document within the slice, byte range, hash."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Plain string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(texts: pa.Array) -> Iterator[Slice]:
    """Cuts a batch between documents."""
    texts = text_array(texts)
    if not len(texts):
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        last = min(last, len(texts))
        yield Slice(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """``h[j] - h[i]`` times ``INVERSE ** i`` is the polynomial of bytes i to j."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * BASE)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of every word of a slice."""
    inside = ~SPACE[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


def words_of(part: Slice, lower: bool = False) -> Words:
    data = LOWER[part.data] if lower else part.data
    doc, start, end = spans(data, part.offsets)
    return Words(doc, start, end, range_hashes(prefix_hashes(data), start, end))


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring values."""
    n = len(hashes) - width + 1
    total = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for i in range(width):
            total += hashes[i : i + n] * np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64))
    return mix(total)


def shingle_lists(part: Slice, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a slice.

    A text of fewer than ``width`` words, but at least one, has one shingle: all its words.
    """
    found = words_of(part)
    bounds = np.searchsorted(found.doc, np.arange(len(part.offsets)))
    runs = run_hashes(found.hash, width)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            out.append(run_hashes(found.hash[a:b], int(b - a)) + np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
