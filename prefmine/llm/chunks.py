"""Ids of many texts from the ids of their distinct chunks.

A text is cut where its tokenizer never joins what stands on both sides, so the ids of a text are those
of its chunks one after the other. Natural text repeats its chunks: each distinct one is encoded once
and kept in a table of bounded size, which is emptied when full. Chunks are told apart by 64-bit hashes;
chunks of more than ``LONG`` bytes are never kept.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from prefmine.llm.words import Slice, prefix_hashes, range_hashes

LONG = 64
#: all ids of the given chunks, and how many each has
Encoder = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


class ChunkTable:
    """Ids of chunks met before, as ranges of one growing array, found by open addressing on their hashes."""

    def __init__(self, encode: Encoder, limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.mask = (1 << (3 * limit - 1).bit_length()) - 1
        self._clear()

    def _clear(self) -> None:
        self.n, self.used = 0, 0
        self.keys, self.slots = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32)
        self.pool = np.zeros(1 << 16, np.int32)
        self.start, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where it is not kept."""
        at = (hashes & np.uint64(self.mask)).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == hashes, self.slots[at], -1)
        open_ = np.flatnonzero((found != hashes) & (found != 0))
        at = at[open_]
        while len(open_):
            at = at + 1 & self.mask
            found = self.keys[at]
            wanted = hashes[open_]
            hit = found == wanted
            out[open_[hit]] = self.slots[at[hit]]
            stay = ~hit & (found != 0)
            open_, at = open_[stay], at[stay]
        return out

    def _add(self, hashes: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        m = len(sizes)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.n + m > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.pool[self.used : self.used + len(flat)] = flat
        self.start[self.n : self.n + m] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + m] = sizes
        self._place(hashes, np.arange(self.n, self.n + m, dtype=np.int32))
        self.used, self.n = self.used + len(flat), self.n + m

    def _place(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        at = (hashes & np.uint64(self.mask)).astype(np.int64)
        while len(hashes):
            free = np.flatnonzero(self.keys[at] == 0)
            first = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[first]], self.slots[at[first]] = hashes[first], slots[first]
            stay = np.ones(len(hashes), bool)
            stay[first] = False
            hashes, slots, at = hashes[stay], slots[stay], at[stay] + 1 & self.mask

    def ids(self, part: Slice, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks of a slice, and how many each chunk has."""
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if self.n > self.limit:
            self._clear()
        short = np.flatnonzero(end - start <= LONG)
        hashes = np.maximum(range_hashes(prefix_hashes(part.data), start[short], end[short]), np.uint64(1))
        slots = self._find(hashes)
        missing = np.flatnonzero(slots < 0)
        raw = part.data.tobytes()
        if len(missing):
            new, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            where = short[missing[first]]
            made = self.encode([raw[a:b] for a, b in zip(start[where].tolist(), end[where].tolist())])
            slots[missing] = self.n + back
            self._grow(len(new))
            self._add(new, *made)
        if len(short) == len(start):
            source, begins, sizes = self.pool, self.start[slots], self.size[slots]
        else:
            long = np.flatnonzero(end - start > LONG)
            flat, lengths = self.encode([raw[start[i] : end[i]] for i in long])
            source = np.concatenate([self.pool[: self.used], flat.astype(np.int32)])
            begins, sizes = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
            begins[short], sizes[short] = self.start[slots], self.size[slots]
            begins[long], sizes[long] = self.used + np.cumsum(lengths) - lengths, lengths
        stops = np.cumsum(sizes)
        take = np.arange(stops[-1]) + np.repeat(begins - (stops - sizes), sizes)
        return source[take], sizes

    def _grow(self, more: int) -> None:
        """Doubles the addresses before they are half full: one slice may bring any number of chunks."""
        while 2 * (self.n + more) > self.mask:
            keys, slots = self.keys[self.keys != 0], self.slots[self.keys != 0]
            self.mask = 2 * self.mask + 1
            self.keys, self.slots = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32)
            self._place(keys, slots)


def ids_per_document(sizes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Offsets of each document's ids, from the sizes and documents of its chunks in order."""
    return np.concatenate([[0], np.cumsum(np.bincount(doc, sizes, n_docs))]).astype(np.int64)


def cut(part: Slice, here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of the chunks that begin at document starts and where ``here`` is set."""
    begins = here.copy()
    starts = part.offsets[:-1]
    begins[starts[starts < len(begins)]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(begins))
    return np.searchsorted(part.offsets, start, "right") - 1, start, end
