"""Audit of how sources differ in their words, with late materialization of strings.

Terms are runs of letters (ASCII letters and everything beyond ASCII, A-Z lower-cased). Each ``lang`` keeps the terms found in at least
``min_docs`` of its documents; sources are compared on these. The steps:

1. ``term_counts``: texts become rows (lang, source, digest, occurrences, documents), combined within a task and again before the
   shuffle. Only 64-bit digests are shuffled, never strings.
2. ``dictionary``: of the digests that are kept, the least and the greatest string. Tasks look terms up in a bitmap of
   fixed size first, so that strings of other terms are shuffled only by chance.
3. Where the two strings of a digest differ, it stands for several terms: these few digests are counted anew by string and split. A digest
   that is not kept can't hide a kept term, as its documents are at least those of each of its terms.
4. Counts become shares ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))`` with exact integers (decimals for the product).
5. Part ``pair``: sources of a language are compared on all its kept terms in blocks: a block has about ``CHUNK`` terms and two
   times ``SOURCES`` sources, whatever their number, so no task holds a language. One row per pair and block is summed up.
6. Part ``term``: terms are ranked by value on digests; only those that can be among the first ``top`` (ties included) get their strings
   back, which then decide ties.

Defined results: null texts, langs and sources count as ''; groups without terms take part; repeated rows are documents of their
own; an empty table gives no rows. Texts are whole, of any length. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmine.core import top_per_key
from prefmine.llm.tables import release_memory, written
from prefmine.llm.words import LOWER, Slice, mix, prefix_hashes, range_hashes, slices

SCALE, SMOOTH = 1_000_000_000, 2
MIN_DOCS, TOP = 10, 10
CHUNK, SOURCES = 2048, 128
BITS = 26
HELD = 1 << 18
SHUFFLED = np.random.default_rng(0).permutation(256).astype(np.uint8)
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True

# --------------------------------------------------------------------------- terms of texts


def term_spans(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of every term of a slice, and the slice in lower case."""
    data = LOWER[part.data]
    inside = LETTER[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cuts = part.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return np.searchsorted(part.offsets, start, "right") - 1, start, end, data


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, bits: int) -> np.ndarray:
    """The lower ``bits`` of the terms' hashes."""
    return (range_hashes(prefix_hashes(data), start, end) & np.uint64((1 << bits) - 1)).view(np.int64)


def _summed(group: np.ndarray, digest: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort((digest, group))
    group, digest = group[order], digest[order]
    first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (digest[1:] != digest[:-1])]))
    return [group[first], digest[first], *[np.add.reduceat(v[order], first) for v in values]]


def _texts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    empty = lambda c, out: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(out)
    return docs.select(empty(lang, "lang"), empty(source, "source"), empty(text, "text"))


def term_counts(texts: DataFrame, bits: int = 64) -> DataFrame:
    """(lang, source, digest, n, docs) of rows (lang, source, text): occurrences and documents of each digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        held: list[list[np.ndarray]] = []

        def table() -> pa.RecordBatch:
            group, digest, n, docs = _summed(*(np.concatenate(c) for c in zip(*held)))
            names = list(groups)
            lang, source = (pa.array([k[i] for k in names]).take(pa.array(group)) for i in (0, 1))
            return pa.RecordBatch.from_arrays([lang, source, pa.array(digest), pa.array(n), pa.array(docs)], ["lang", "source", "digest", "n", "docs"])

        for batch in batches:
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            number = np.array([groups.setdefault(k, len(groups)) for k in keys], np.int64)
            for part in slices(batch.column("text")):
                doc, start, end, data = term_spans(part)
                if len(start):
                    doc, digest, n = _summed(doc, digests(data, start, end, bits), np.ones(len(start), np.int64))
                    held.append(_summed(number[part.first + doc], digest, n, np.ones(len(doc), np.int64)))
            if sum(len(h[0]) for h in held) > HELD:
                held = [_summed(*(np.concatenate(c) for c in zip(*held)))]
                if len(held[0][0]) > HELD // 2:
                    yield table()
                    held, groups = [], {}
        if held:
            yield table()
        release_memory()

    return texts.mapInArrow(run, "lang string, source string, digest long, n long, docs long")


def _strings(texts: DataFrame, bits: int, wanted: np.ndarray, by_source: bool) -> DataFrame:
    """(lang, source, digest, term, n, docs) of the terms whose digest's place in the bitmap ``wanted`` is set."""
    held_by = texts.sparkSession.sparkContext.broadcast(wanted.tobytes())  # 8 MB at every size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(held_by.value, np.uint8)
        numbers: dict[str, int] = {}
        seen = np.zeros(0, np.uint64)  # marks of the strings that this task has given already
        for batch in batches:
            langs, sources = (batch.column(n).to_pylist() for n in ("lang", "source"))
            for part in slices(batch.column("text")):
                doc, start, end, data = term_spans(part)
                whole = range_hashes(prefix_hashes(data), start, end)
                place = whole & np.uint64((1 << min(BITS, bits)) - 1)
                at = np.flatnonzero(bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1)
                doc, start, end, whole = doc[at], start[at], end[at], whole[at]
                digest = (whole & np.uint64((1 << bits) - 1)).view(np.int64)
                raw = data.tobytes()
                out: dict[tuple, list[int]] = {}
                if by_source:
                    found: dict[tuple, int] = {}
                    for d, s, e, h in zip(doc.tolist(), start.tolist(), end.tolist(), digest.tolist()):
                        key = (d, h, raw[s:e])
                        found[key] = found.get(key, 0) + 1
                    for (d, h, term), n in found.items():
                        sums = out.setdefault((langs[part.first + d], sources[part.first + d], h, term), [0, 0])
                        sums[0], sums[1] = sums[0] + n, sums[1] + 1
                elif len(at):
                    # a string is given once; a hash that is independent of the digest tells strings of one digest apart
                    lang_of = np.array([numbers.setdefault(langs[part.first + d], len(numbers)) for d in range(len(part.offsets) - 1)], np.uint64)[doc]
                    marks, first = np.unique(mix(range_hashes(prefix_hashes(SHUFFLED[data]), start, end) + lang_of) ^ whole, return_index=True)
                    at = np.searchsorted(seen, marks)
                    fresh = np.concatenate([seen, marks[-1:]])[at] != marks
                    fresh[at == len(seen)] = True
                    for i in first[fresh].tolist():
                        out[langs[part.first + doc[i]], "", int(digest[i]), raw[start[i] : end[i]]] = [0, 0]
                    seen = np.sort(np.concatenate([seen, marks[fresh]]), kind="stable") if len(seen) < HELD else marks
                if out:
                    yield _string_rows(out)
        release_memory()

    return texts.mapInArrow(run, "lang string, source string, digest long, term string, n long, docs long")


def _string_rows(out: dict[tuple, list[int]]) -> pa.RecordBatch:
    lang, source, digest, term = zip(*out)
    n, docs = zip(*out.values())
    columns = [pa.array(lang), pa.array(source), pa.array(digest, pa.int64()), pa.array([t.decode() for t in term]), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "digest", "term", "n", "docs"])


def bitmap_of(digests_: DataFrame) -> np.ndarray:
    """Bitmap over the lower ``BITS`` of the digests: at most 2^20 words come to the driver, whatever the input."""
    place = F.col("digest").bitwiseAND(F.lit((1 << BITS) - 1))
    words = digests_.select(F.shiftright(place, 6).alias("at"), F.expr("shiftleft(1L, cast(digest & 63 as int))").alias("bit"))
    words = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


# --------------------------------------------------------------------------- kept terms


def kept_terms(texts: DataFrame, min_docs: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(counts, dictionary): (lang, source, digest, part, n) and (lang, digest, part, term) of the kept terms.

    ``part`` is 0 but for digests that stand for several terms.
    """
    counts = written(term_counts(texts, bits).groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    kept = written(counts.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "digest"), "kept")
    ends = _strings(texts, bits, bitmap_of(kept), by_source=False).groupBy("lang", "digest").agg(F.min("term").alias("term"), F.max("term").alias("other"))
    dictionary = written(ends.join(kept, ["lang", "digest"]), "dictionary")
    single = dictionary.filter("term = other").select("lang", "digest", F.lit(0).alias("part"), "term")
    mixed = dictionary.filter("term <> other").select("lang", "digest")
    clean = counts.join(dictionary.filter("term = other").select("lang", "digest"), ["lang", "digest"]).select("lang", "source", "digest", F.lit(0).alias("part"), "n")
    if not mixed.limit(1).count():
        return written(clean, "kept-counts"), single
    again = _strings(texts, bits, bitmap_of(mixed), by_source=True).join(mixed, ["lang", "digest"])
    again = written(again.groupBy("lang", "source", "digest", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "split-counts")
    enough = again.groupBy("lang", "digest", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    enough = written(enough.select("lang", "digest", F.row_number().over(Window.partitionBy("lang", "digest").orderBy("term")).alias("part"), "term"), "split")
    parts = again.join(enough, ["lang", "digest", "term"]).select("lang", "source", "digest", "part", "n")
    return written(clean.unionByName(parts), "kept-counts"), single.unionByName(enough)


# --------------------------------------------------------------------------- shares and values


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10^9 (count + 2) / (total + 2 terms))``: the product needs more than 64 bits."""
    product = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTH).cast("decimal(20,0)")
    return F.call_function("div", product, (total + SMOOTH * terms).cast("decimal(20,0)")) + 1


def pair_values(counts: DataFrame, groups: DataFrame, langs: DataFrame, chunk: int, sources: int) -> DataFrame:
    """(lang, a, b, value): for the numbers of any two sources of a language, the values summed over its kept terms."""
    pieces = langs.select("lang", F.ceil(F.col("terms") / chunk).cast("int").alias("pieces")).filter("pieces > 0")
    sized = groups.groupBy("lang").agg(F.ceil((F.max("number") + 1) / sources).cast("int").alias("blocks")).join(pieces, "lang")
    numbered = groups.join(sized, "lang").select("lang", "source", "number", "terms", "total", "pieces", "blocks", F.floor(F.col("number") / sources).cast("int").alias("block"))
    piece = lambda n: F.pmod(F.xxhash64("digest", "part"), n).cast("int").alias("piece")
    in_piece = counts.join(pieces, "lang").groupBy("lang", "digest", "part").agg(F.first("pieces").alias("pieces"))
    sizes = in_piece.groupBy("lang", piece(F.col("pieces"))).agg(F.count(F.lit(1)).alias("size"))
    values = counts.join(numbered, ["lang", "source"]).select(
        "lang", "block", "blocks", "number", piece(F.col("pieces")), F.xxhash64("digest", "part").alias("id"), share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), F.lit(False).alias("base"),
    )
    bases = numbered.join(sizes, "lang").select(
        "lang", "block", "blocks", "number", "piece", F.col("size").alias("id"), share(F.lit(0), F.col("total"), F.col("terms")).alias("p"), F.lit(True).alias("base"),
    )
    rows = values.unionByName(bases).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("lang", "piece", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "number", "id", "p", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        number, block, ids, p, base = (table[c].to_numpy() for c in ("number", "block", "id", "p", "base"))
        at = np.flatnonzero(base)
        at = at[np.argsort(number[at])]
        own, floor, size = number[at], p[at], int(ids[at[0]])
        side = block[at]
        terms, row = np.unique(ids[~base], return_inverse=True)
        grid = np.repeat(floor[:, None], len(terms), 1)
        grid[np.searchsorted(own, number[~base]), row] = p[~base]
        value = lambda x, y: (x - y) * (x - y) // (x + y)  # noqa: E731  below 2^60
        left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
        out = []
        for i in left:
            others = right[right > i] if low == high else right
            if len(others):
                sums = value(grid[i], grid[others]).sum(1) + (size - len(terms)) * value(floor[i], floor[others])
                out.append((np.full(len(others), own[i]), own[others], sums))
        release_memory()
        if out:
            a, b, v = (np.concatenate(c) for c in zip(*out))
            lang = pa.array([table["lang"][0].as_py()] * len(a), pa.string())
            yield pa.RecordBatch.from_arrays([lang, pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(v, pa.int64())], ["lang", "a", "b", "value"])

    blocks = rows.groupBy("lang", "piece", "low", "high").applyInArrow(run, "lang string, a long, b long, value long")
    return blocks.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, bits: int = 64, chunk: int = CHUNK, sources: int = SOURCES
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) of both parts."""
    texts = _texts(docs, lang, source, text)
    counts, dictionary = kept_terms(texts, min_docs, bits)
    totals = counts.groupBy("lang", "digest", "part").agg(F.sum("n").alias("n"))
    totals = written(totals, "term-totals")
    known = texts.select("lang", "source").distinct()
    sizes = totals.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    langs = known.select("lang").distinct().join(sizes, "lang", "left").na.fill(0)
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("bigint").alias("number")
    groups = known.join(langs, "lang").join(own, ["lang", "source"], "left").na.fill(0, ["total"])
    groups = written(groups.select("lang", "source", number, "terms", "lang_total", "total"), "groups")
    langs = groups.select("lang", "terms").distinct()

    both = written(pair_values(counts, groups, langs, chunk, sources), "pairs")
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    one, two = (groups.select("lang", F.col("source").alias(s), F.col("number").alias(n)) for s, n in (("source", "a"), ("item", "b")))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = one.join(two, "lang").filter("a <> b").join(both, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))

    q = share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    p = share(F.col("n"), F.col("total"), F.col("terms"))
    valued = counts.join(totals.withColumnRenamed("n", "lang_n"), ["lang", "digest", "part"]).join(groups.drop("number"), ["lang", "source"])
    valued = valued.select("lang", "source", "digest", "part", p.alias("p"), q.alias("q")).filter("p > q")
    valued = valued.withColumn("value", F.expr("(p - q) * (p - q) div (p + q)"))
    first = valued.withColumn("place", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).filter(F.col("place") <= top)
    named = first.join(dictionary, ["lang", "digest", "part"]).select("lang", "source", F.col("term").alias("item"), "value")
    terms = top_per_key(named, ["lang", "source"], [F.desc("value"), F.col("item")], top)
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return pairs.unionByName(terms)
