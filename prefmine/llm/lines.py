"""Line-first cleaning: judge every line, remove those that fail, then reject documents that lost too much.

A line with words fails if
- boilerplate: it holds one of the phrases of ``BOILERPLATE`` (ASCII letters compared without case);
- navigation: more than one separator (``|`` or ``>``) per ``words_per_separator`` words;
- punctuation: it has no sentence end (a word ending in one of ``.!?``, not repeated, closing quotes
  aside), more than ``words_per_end`` words per sentence end, or symbols of ``[#*$%&|<>]`` in more than
  one word of five.
Lines without a word are neither judged nor removed. A document is kept if it passes the base rules
(``n_words >= 50``, at most half of the words in repeated three-word runs) and the removed lines hold at
most ``max_loss`` of its words. Null and empty texts have no words and are not kept. Rows are judged
one by one, so repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from prefmine.llm.style import Form, form_of
from prefmine.llm.tables import with_columns
from prefmine.llm.words import LOWER, Slice, prefix_hashes, range_hashes, slices

BOILERPLATE = (
    "all rights reserved", "is licensed under", "licensed under the", "licensed under cc", "released under the", "terms of use",
    "terms of service", "privacy policy", "cookie policy", "use cookies", "enable javascript", "lorem ipsum", "sign up for our",
    "subscribe to our", "click here", "share this", "skip to content",
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "n_words_removed")


def _marked(part: Slice, form: Form) -> np.ndarray:
    """Lines that hold a boilerplate phrase."""
    out = np.zeros(len(form.line_start), bool)
    raw = LOWER[part.data].tobytes()
    for phrase in BOILERPLATE:
        wanted, at = phrase.encode(), raw.find(phrase.encode())
        while at >= 0:
            line = int(np.searchsorted(form.line_start, at, "right")) - 1
            if at + len(wanted) <= form.line_end[line]:
                out[line] = True
            at = raw.find(wanted, at + 1)
    return out


def failed_lines(part: Slice, form: Form, words_per_separator: int, words_per_end: int) -> np.ndarray:
    full = form.line_words > 0
    navigation = (form.line_separators > 1) & (form.line_separators * words_per_separator > form.line_words)
    punctuation = (form.line_ends == 0) | (form.line_words > words_per_end * form.line_ends) | (5 * form.line_noisy > form.line_words)
    return full & (_marked(part, form) | navigation | punctuation)


def _repeated_lines(part: Slice, form: Form) -> np.ndarray:
    """Per document: lines with a word that equal an earlier line of it."""
    full = np.flatnonzero(form.line_words > 0)
    hashes = range_hashes(prefix_hashes(part.data), form.line_start[full], form.line_end[full])
    keys = hashes ^ (form.line_doc[full].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.unique(keys, return_index=True)[1]
    again = np.ones(len(full), bool)
    again[first] = False
    return np.bincount(form.line_doc[full[again]], minlength=len(part.offsets) - 1)


def clean_lines(
    df: DataFrame, text: str = "text", clean_text: str | None = "clean_text", max_loss: float = 0.3,
    words_per_separator: int = 8, words_per_end: int = 120,
) -> DataFrame:
    """Appends the counts in ``COUNTS``, ``base_failed``, ``kept`` and, if named, the text without failed lines."""
    fields = [T.StructField(c, T.LongType()) for c in COUNTS]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    fields += [T.StructField(clean_text, T.StringType())] if clean_text else []

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        columns: dict[str, list] = {f.name: [] for f in fields}
        for part in slices(batch.column(text)):
            form = form_of(part)
            n_docs = len(part.offsets) - 1
            failed = failed_lines(part, form, words_per_separator, words_per_end)
            lost = np.bincount(form.line_doc, form.line_words * failed, n_docs).astype(np.int64)
            base = (form.n_words < 50) | (100 * form.n_repeat_words > 50 * form.n_words)
            values = (
                form.n_words, form.word_chars, form.n_symbols, _repeated_lines(part, form), form.n_repeat_words,
                np.bincount(form.line_doc, failed, n_docs).astype(np.int64), lost, base, ~base & (lost <= max_loss * form.n_words),
            )
            for name, value in zip((*COUNTS, "base_failed", "kept"), values):
                columns[name].append(value)
            if clean_text:
                kept: list[list[bytes]] = [[] for _ in range(n_docs)]
                raw = part.data.tobytes()
                for line in np.flatnonzero(~failed):
                    kept[form.line_doc[line]].append(raw[form.line_start[line] : form.line_end[line]])
                columns[clean_text] += [b"\n".join(k).decode() for k in kept]
        out = {n: pa.array(np.concatenate(v) if v else []) for n, v in columns.items() if n != clean_text}
        out = {n: v.cast(pa.bool_() if n in ("base_failed", "kept") else pa.int64()) for n, v in out.items()}
        return out | ({clean_text: pa.array(columns[clean_text], pa.string())} if clean_text else {})

    return with_columns(df, make, fields)
