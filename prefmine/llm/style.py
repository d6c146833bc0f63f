"""Counts of form over whole texts, per line and per document, from one pass over the bytes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from prefmine.llm.words import Slice, prefix_hashes, range_hashes, run_hashes, spans


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


SYMBOL = _flags("#*$%&|<>")
TERMINAL = _flags(".!?")
CLOSING = _flags("\"')]")
SEPARATOR = _flags("|>")
DIGIT = _flags("0123456789")
UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = _flags("abcdefghijklmnopqrstuvwxyz")
CONTINUATION = np.zeros(256, bool)
CONTINUATION[0x80:0xC0] = True


class Form(NamedTuple):
    """``line_*`` have one entry per line, the others one per document of the slice."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_repeat_words: np.ndarray
    n_ends: np.ndarray
    n_caps: np.ndarray
    n_noisy: np.ndarray
    n_digits: np.ndarray
    n_distinct: np.ndarray
    line_doc: np.ndarray
    line_start: np.ndarray
    line_end: np.ndarray
    line_words: np.ndarray
    line_ends: np.ndarray
    line_noisy: np.ndarray
    line_separators: np.ndarray


def _per(total: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum per document of a 0/1 or count array over bytes."""
    run = np.concatenate([[0], np.cumsum(total, dtype=np.int64)])
    return run[offsets[1:]] - run[offsets[:-1]]


def form_of(part: Slice) -> Form:
    data, offsets = part.data, part.offsets
    n_docs = len(offsets) - 1
    doc, start, end = spans(data, offsets)
    hashes = range_hashes(prefix_hashes(data), start, end)
    count = lambda values: np.bincount(doc, values, n_docs).astype(np.int64)

    run = lambda flags: np.concatenate([[0], np.cumsum(flags[data], dtype=np.int64)])
    inner = run(CONTINUATION)
    chars = (end - start) - (inner[end] - inner[start])
    symbols = run(SYMBOL)
    digits = run(DIGIT)
    upper, lower = run(UPPER), run(LOWER)

    # a word ends a sentence if it ends in one terminal mark, closing quotes aside
    last = end - 1
    if len(last):
        closing = CLOSING[data[last]] & (last > start)
        last = last - closing
        before = np.maximum(last - 1, start)
        ends = TERMINAL[data[last]] & ~(TERMINAL[data[before]] & (before < last))
    else:
        ends = np.zeros(0, bool)
    caps = (upper[end] - upper[start] >= 2) & (lower[end] == lower[start])
    noisy = symbols[end] > symbols[start]

    # words inside three-word runs that occur twice or more in their document
    repeated = np.zeros(len(start), bool)
    if len(start) >= 3:
        runs = run_hashes(hashes, 3)
        inside = doc[2:] == doc[:-2]
        keys = runs ^ (doc[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = np.flatnonzero(inside)
        _, back, counts = np.unique(keys[at], return_inverse=True, return_counts=True)
        twice = at[counts[back] >= 2]
        for shift in range(3):
            repeated[twice + shift] = True
    own = np.unique(hashes ^ (doc.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)), return_index=True)[1]

    # lines: cut at every newline and at every document's start
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_doc = np.concatenate([np.arange(n_docs), np.searchsorted(offsets, breaks, "right") - 1])
    line_doc = np.sort(line_doc)
    nexts = np.append(line_start[1:] - 1, len(data))
    same = np.append(line_doc[1:] == line_doc[:-1], False)
    line_end = np.where(same, nexts, offsets[1:][line_doc])
    # an empty document's line and its follower's first line start at the same byte: place words by document first
    line_of = np.searchsorted(line_start, start, "right") - 1
    n_lines = len(line_start)
    separators = run(SEPARATOR)
    return Form(
        n_words=np.bincount(doc, minlength=n_docs).astype(np.int64),
        word_chars=count(chars),
        n_symbols=_per(SYMBOL[data], offsets),
        n_repeat_words=count(repeated),
        n_ends=count(ends),
        n_caps=count(caps),
        n_noisy=count(noisy),
        n_digits=count(digits[end] - digits[start]),
        n_distinct=np.bincount(doc[own], minlength=n_docs).astype(np.int64),
        line_doc=line_doc,
        line_start=line_start,
        line_end=line_end,
        line_words=np.bincount(line_of, minlength=n_lines).astype(np.int64),
        line_ends=np.bincount(line_of, ends, n_lines).astype(np.int64),
        line_noisy=np.bincount(line_of, noisy, n_lines).astype(np.int64),
        line_separators=separators[line_end] - separators[line_start],
    )
