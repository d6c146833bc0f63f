"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text knows every substring of it. A text is parsed against each
automaton: the longest match from where the parse stands is a phrase, then the next one begins; a byte that the language never showed
is a phrase of its own. A text of ``c`` phrases against a language of ``n`` labelled bytes costs ``c log2(n)`` bits, to be
divided by its length: the language with the least bits per byte wins, the lesser name if tied. The score is the
runner-up's share of the bits of the best two, between 0.5 and 1 (1 if there is one language only).

Texts are taken in lower case; what is neither an ASCII letter nor beyond ASCII counts as a space, runs of it as one. Whole texts
are parsed. A phrase ends at every ``PIECE``-th byte at the latest: all pieces of a batch then advance together, one table
lookup a byte and language, and a very long text is many short pieces.

The labelled sample is bounded: ``sample_bytes`` for all languages together, in equal shares, from at most ``sample_rows`` distinct
texts a language, the first by their hash, a window of each. Only this sample comes to the driver; workers build the automata from it.

Null texts, and texts without a letter, are ``und`` with score 0, and so are all if nothing could be learned. Rows labelled null, or
without a letter, teach nothing. Repeated texts of a language teach once. Rows come back as they are, extra columns too.
"""

from __future__ import annotations

import math
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmine.core import top_per_key
from prefmine.llm.tables import with_columns
from prefmine.llm.words import Slice, slices, text_array

UNKNOWN = "und"
PIECE = 1024
SPACE = 32
_CLASS = np.full(256, SPACE, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


class Samples(NamedTuple):
    """Languages in order of name, and the labelled bytes of each."""

    names: tuple[str, ...]
    texts: tuple[bytes, ...]


class SuffixAutomaton:
    """Smallest automaton of all substrings; state 0 is the start, ``next`` has the transitions of each state."""

    def __init__(self, text: bytes):
        self.next: list[dict[int, int]] = [{}]
        length, link, last = [0], [-1], 0
        for symbol in text:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and symbol not in self.next[at]:
                self.next[at][symbol] = new
                at = link[at]
            if at >= 0:
                to = self.next[at][symbol]
                if length[to] == length[at] + 1:
                    link[new] = to
                else:  # a shorter copy of ``to`` takes the transitions from here on
                    copy = len(self.next)
                    self.next.append(dict(self.next[to]))
                    length.append(length[at] + 1)
                    link.append(link[to])
                    while at >= 0 and self.next[at].get(symbol) == to:
                        self.next[at][symbol] = copy
                        at = link[at]
                    link[to] = link[new] = copy
            last = new


class Parser:
    """Phrase counts of many texts against all languages at once.

    ``step`` has, for each state and symbol, twice the offset of the next state, plus 1 if the symbol begins a phrase.
    """

    def __init__(self, texts: tuple[bytes, ...]):
        used = sorted(set(b"".join(texts)))
        self.symbol = np.zeros(256, np.int32)
        self.symbol[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        tables, self.start, first = [], [], 0
        for text in texts:
            states = SuffixAutomaton(text).next
            where = np.array([(s, b, to) for s, row in enumerate(states) for b, to in row.items()], np.int64).reshape(-1, 3)
            goes = np.zeros((len(states), width), np.int64)  # 0: no transition, as none leads back to the start
            goes[where[:, 0], self.symbol[where[:, 1]]] = where[:, 2]
            ends = goes == 0
            ends[0] = True  # the start: whatever comes begins a phrase
            goes = np.where(goes == 0, goes[0], goes)
            tables.append(((goes + first) * width * 2 + ends).ravel())
            self.start.append(first * width)
            first += len(states)
        self.step = np.concatenate(tables).astype(np.int32 if first * width < 1 << 30 else np.int64)
        self.start = np.array(self.start, self.step.dtype)

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(languages, documents) phrases of normalised bytes."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // PIECE)
        doc = np.repeat(np.arange(len(sizes)), pieces)
        begin = offsets[doc] + PIECE * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        length = np.minimum(PIECE, offsets[doc + 1] - begin)
        order = np.argsort(-length, kind="stable")
        doc, begin, length = doc[order], begin[order], length[order]
        symbols = self.symbol[data].astype(self.step.dtype)
        state = np.repeat(self.start[:, None], len(doc), 1)
        count = np.zeros(state.shape, np.int32)
        ends = np.searchsorted(-length, -np.arange(1, PIECE + 1), "right")  # pieces that have a byte at each step
        for at in range(int(length[0]) if len(length) else 0):
            n = ends[at]
            went = self.step[state[:, :n] + symbols[begin[:n] + at]]
            count[:, :n] += went & 1
            state[:, :n] = went >> 1
        return np.stack([np.bincount(doc, c, len(sizes)) for c in count]).astype(np.int64) if len(count) else np.zeros((0, len(sizes)), np.int64)


@lru_cache(maxsize=2)
def parser(texts: tuple[bytes, ...]) -> Parser:
    return Parser(texts)


def normalised(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a slice of lower-case texts with spaces in runs of one, and the offsets of each text."""
    data = _CLASS[part.data]
    letter = data != SPACE
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    starts = part.offsets[:-1]
    starts = starts[starts < len(data)]
    keep[starts] = letter[starts]
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[part.offsets]


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = 64, sample_bytes: int = 1 << 17) -> Samples:
    """The bounded sample of labelled rows."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("lang IS NOT NULL").filter(F.col("text").rlike("\\p{L}"))
    rows = rows.withColumn("key", F.xxhash64("text"))
    chosen = top_per_key(rows.select("lang", "key").distinct(), ["lang"], [F.col("key")], sample_rows)
    share = sample_bytes // max(1, chosen.select("lang").distinct().count())
    window = F.lit(max(16, share // sample_rows))
    # the window's place follows from the hash, so beginnings weigh no more than the rest
    begin = F.pmod("key", F.greatest(F.length("text") - window + 1, F.lit(1))).cast("int") + 1
    found = rows.join(chosen, ["lang", "key"]).groupBy("lang", "key").agg(F.min(F.substring(F.col("text"), begin, window)).alias("text")).toPandas()
    found = found.sort_values(["lang", "key"], kind="stable")
    names = tuple(sorted(found["lang"].unique()))
    texts = []
    for name in names:
        part = next(slices(pc.utf8_lower(text_array(pa.array([" ".join(found["text"][found["lang"] == name])])))))
        texts.append(normalised(part)[0].tobytes()[: max(share, 16)])
    return Samples(names, tuple(texts))


def predict(df: DataFrame, samples: Samples, text: str = "text", out: str = "lang_pred", score: str = "score", bits: str = "bits_per_byte") -> DataFrame:
    """Appends the language, its score and the bits per byte against it (null if undetermined)."""
    fields = [T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(bits, T.DoubleType())]
    rows = df.withColumn("__letters", F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)))

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        lettered = batch.column("__letters").to_numpy(zero_copy_only=False)
        known = lettered if samples.names else np.zeros(len(batch), bool)
        best, sure, cost = np.zeros(len(batch), np.int64), np.zeros(len(batch)), np.zeros(len(batch))
        if known.any():
            parse = parser(samples.texts)
            weight = np.array([math.log2(len(t) + 1) for t in samples.texts])[:, None]
            for part in slices(pc.utf8_lower(text_array(batch.column(text)))):
                data, offsets = normalised(part)
                spent = weight * parse.phrases(data, offsets)
                at = slice(part.first, part.first + spent.shape[1])
                best[at] = spent.argmin(0)
                ordered = np.sort(spent, 0)
                cost[at] = ordered[0] / np.maximum(np.diff(offsets), 1)
                sure[at] = ordered[1] / np.maximum(ordered[0] + ordered[1], 1e-9) if len(ordered) > 1 else 1.0
        names = pa.array([*samples.names, UNKNOWN])
        return {
            out: names.take(pa.array(np.where(known, best, len(samples.names)))), score: pa.array(np.where(known, sure, 0.0)), bits: pa.array(cost, mask=~known),
        }

    return with_columns(rows, make, fields).drop("__letters")
