"""Token-id files in a Simple-8b word-aligned code.

A stream of ids is cut into blocks of at most ``BLOCK`` ids. Each 64-bit little-endian word has a
four-bit selector in its top bits and 60 bits of payload. Selector ``s`` holds ``COUNTS[s]`` values of
``WIDTHS[s]`` bits, the first in the lowest bits; selector 0 is a run of 240 zeros. Selector 15 is an
escape for a value of more than 60 bits: its payload is a place in the block's list of escaped values.
The last word of a block may hold fewer values than its selector says; the block's count tells. A block
is: count, words, escapes (three u32), the words, the escaped values (u64).

A file row holds consecutive documents: their ids, how many token ids each has, the offset of every
block in the payload, and the payload. Rows are Parquet, written and read by Spark, so any store that
Spark reaches will do and a lost task is written again whole.

Null texts count as empty and have only the end id. Unknown document ids come first. Repeated rows are
kept, each in its place. An empty table gives a file without rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefmine.core import scratch_path
from prefmine.llm.chunks import ChunkTable, cut, ids_per_document
from prefmine.llm.words import Slice, slices

WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60], np.int64)
COUNTS = np.array([240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
ESCAPE = 15
SELECTOR = np.full(int(COUNTS[0]) + 1, ESCAPE, np.int64)
SELECTOR[COUNTS[:ESCAPE]] = np.arange(ESCAPE)
BLOCK = 1 << 16
ROW_IDS = 1 << 19
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
HEADER = 12


# --------------------------------------------------------------------------- the code


def _choose(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Selector and first value of every word: at each value the selector that takes most of what follows.

    Behind the last value zeros are thought, so the last word takes what is left.
    """
    n, largest = len(values), int(values.max())
    padded = np.zeros(n + int(COUNTS.max()), np.uint32 if largest < 1 << 32 else np.uint64)
    padded[:n] = values
    step = np.zeros(n, np.int16)  # values taken; 0 where only an escape is left
    for s in range(ESCAPE):
        width, count = int(WIDTHS[s]), int(COUNTS[s])
        if largest >> width == 0:  # fits everywhere
            np.maximum(step, count, out=step)
            break
        narrow = np.zeros(len(padded) + 1, np.int32)
        np.cumsum(padded < (1 << width), out=narrow[1:])
        fits = narrow[count : count + n] - narrow[:n] == count
        np.maximum(step, fits * np.int16(count), out=step)
    starts, at, steps = [], 0, np.maximum(step, 1).tolist()
    while at < n:
        starts.append(at)
        at += steps[at]
    first = np.array(starts, np.int64)
    return SELECTOR[step[first]], first


def encode_block(values: np.ndarray) -> bytes:
    """One block of unsigned 64-bit values."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(3, "<u4").tobytes()
    selector, first = _choose(values)
    words = selector.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([values, np.zeros(int(COUNTS.max()), np.uint64)])
    for s in range(1, ESCAPE):
        at = np.flatnonzero(selector == s)
        if len(at):
            places = np.arange(COUNTS[s])
            shifts = (places * WIDTHS[s]).astype(np.uint64)
            words[at] |= np.bitwise_or.reduce(padded[first[at][:, None] + places] << shifts, axis=1)
    at = np.flatnonzero(selector == ESCAPE)
    words[at] |= np.arange(len(at), dtype=np.uint64)
    head = np.array([n, len(words), len(at)], "<u4")
    return head.tobytes() + words.astype("<u8").tobytes() + values[first[at]].astype("<u8").tobytes()


def decode_block(payload: bytes, offset: int = 0) -> np.ndarray:
    """The values of the block that starts at ``offset``."""
    n, n_words, n_escapes = (int(x) for x in np.frombuffer(payload, "<u4", 3, offset))
    words = np.frombuffer(payload, "<u8", n_words, offset + HEADER)
    escaped = np.frombuffer(payload, "<u8", n_escapes, offset + HEADER + 8 * n_words)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    first = np.cumsum(counts) - counts
    out = np.zeros(n + int(COUNTS.max()), np.uint64)
    for s in range(1, ESCAPE):
        at = np.flatnonzero(selector == s)
        if len(at):
            places = np.arange(COUNTS[s])
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            out[first[at][:, None] + places] = (words[at][:, None] >> (places * WIDTHS[s]).astype(np.uint64)) & mask
    at = np.flatnonzero(selector == ESCAPE)
    out[first[at]] = escaped[(words[at] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:n]


def encode(values: np.ndarray) -> tuple[bytes, list[int]]:
    """Payload of any number of values and the offset of each of its blocks."""
    parts, offsets, at = [], [], 0
    for i in range(0, len(values), BLOCK):
        parts.append(encode_block(values[i : i + BLOCK]))
        offsets.append(at)
        at += len(parts[-1])
    return b"".join(parts), offsets


def decode(payload: bytes, offsets: list[int], first: int = 0, last: int | None = None) -> np.ndarray:
    """Values ``first`` to ``last`` of a payload; only the blocks that hold them are decoded."""
    wanted = offsets[first // BLOCK : None if last is None else -(-last // BLOCK)]
    if not len(wanted):
        return np.zeros(0, np.uint64)
    skipped = first // BLOCK * BLOCK
    found = np.concatenate([decode_block(payload, int(o)) for o in wanted])
    return found[first - skipped : None if last is None else last - skipped]


# --------------------------------------------------------------------------- byte-level tokenizer

_tokenizers: dict[str, tuple] = {}


def _byte_level(path: str):
    """Tokenizer of a file, whether its texts may be cut before spaces, the strings of its added tokens, its chunks."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            import json

            spec = json.load(file)
        before = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
        added = [t["content"].encode() for t in spec["added_tokens"]]

        # pieces that begin with a space, for finding chunks again in the ids of many chunks in a row
        vocabulary = tokenizer.get_vocab()
        led = np.zeros(max(vocabulary.values()) + 1, bool)
        led[[i for p, i in vocabulary.items() if p.startswith("\u0120")]] = True

        def ids(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            simple = np.fromiter((c[:1] == b" " and c.rfind(b" ") == 0 for c in chunks), bool, len(chunks))
            order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
            n = int(simple.sum())
            groups = [order[i : min(i + 500, n)] for i in range(0, n, 500)]
            texts = [b"".join([chunks[i] for i in g.tolist()]).decode() for g in groups] + [chunks[i].decode() for i in order[n:]]
            found = [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes = np.zeros(len(chunks), np.int64)
            for g, f in zip(groups, found):
                starts = np.flatnonzero(led[f])
                if len(starts) != len(g) or starts[0] != 0:
                    raise ValueError("the tokenizer joins chunks")
                sizes[g] = np.diff(np.append(starts, len(f)))
            sizes[order[n:]] = [len(f) for f in found[len(groups) :]]
            # from encoding order back to the given order
            flat, stops = np.concatenate(found), np.cumsum(sizes[order])
            begins = np.zeros(len(chunks), np.int64)
            begins[order] = stops - sizes[order]
            ends = np.cumsum(sizes)
            return flat[np.arange(ends[-1]) + np.repeat(begins - (ends - sizes), sizes)], sizes

        _tokenizers[path] = (tokenizer, plain, added, ChunkTable(ids))
    return _tokenizers[path]


def token_ids(part: Slice, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents of a slice, and the offsets of each, by the tokenizers library.

    A byte-level tokenizer splits texts before a space that a non-space follows, between a letter and a
    full stop or comma, and around a newline that stands alone, so texts are cut there. Texts that hold the string of an added token are given to the library whole.
    """
    tokenizer, plain, added, table = _byte_level(path)
    raw, n_docs = part.data.tobytes(), len(part.offsets) - 1
    if not plain or any(a in raw for a in added):
        whole = [raw[a:b].decode() for a, b in zip(part.offsets[:-1], part.offsets[1:])]
        found = [e.ids for e in tokenizer.encode_batch(whole, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, n_docs)
        return np.fromiter((i for f in found for i in f), np.int32, int(sizes.sum())), np.concatenate([[0], np.cumsum(sizes)])
    data = part.data
    here = np.zeros(len(data), bool)
    # lead bytes C2, E1, E2 and E3 may begin a space of several bytes: no cut before those
    here[:-1] = (data[:-1] == 32) & (data[1:] > 32) & (data[1:] != 0x7F) & ~np.isin(data[1:], [0xC2, 0xE1, 0xE2, 0xE3])
    stops = part.offsets[1:]
    here[stops[stops > 0] - 1] = False
    if len(data) > 2:
        letter = LETTER[data]
        here[1:] |= letter[:-1] & ((data[1:] == 44) | (data[1:] == 46))
        seen = (data > 32) & (data < 0x7F)
        alone = (data[1:-1] == 10) & seen[:-2] & seen[2:]
        starts = part.offsets[1:-1]
        for edge in (starts[(starts > 0) & (starts < len(data) - 1)] - 1, starts[(starts > 1) & (starts <= len(data) - 1)] - 2):
            alone[edge[(edge >= 0) & (edge < len(alone))]] = False
        here[1:-1] |= alone
        here[2:] |= alone
    doc, start, end = cut(part, here)
    ids, sizes = table.ids(part, start, end)
    return ids, ids_per_document(sizes, doc, n_docs)


# --------------------------------------------------------------------------- files

FILE = "part int, seq int, n_ids long, doc_ids array<long>, sizes array<int>, offsets array<long>, payload binary"


def write_ids(docs: DataFrame, tokenizer: str, path: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 0) -> None:
    """Encodes texts and writes their ids in ascending order of ``doc_id``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = rows.repartitionByRange(parts, F.asc_nulls_first("id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("id"), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []  # (id, ids)
        size = 0

        def row() -> pa.RecordBatch:
            payload, offsets = encode(np.concatenate([h[1] for h in held]).astype(np.uint64))
            values = [part, seq, size, [h[0] for h in held], [len(h[1]) for h in held], offsets, payload]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], [f.split()[0] for f in FILE.split(", ")])

        for batch in batches:
            names = batch.column("id").to_pylist()
            for piece in slices(batch.column("text")):
                ids, bounds = token_ids(piece, tokenizer)
                for i in range(len(bounds) - 1):
                    own = ids[bounds[i] : bounds[i + 1]]
                    held.append((names[piece.first + i], own if end_id is None else np.append(own, end_id)))
                    size += len(held[-1][1])
                    if size >= ROW_IDS:
                        yield row()
                        seq, held, size = seq + 1, [], 0
        if held:
            yield row()

    placed.mapInArrow(run, FILE).write.parquet(path)


def read_ids(spark: SparkSession, path: str, make: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """Per document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, and what ``make``
    derives from its ids; ``schema`` names its values."""
    rows = spark.read.parquet(path)
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(row["payload"], row["offsets"])
                stops = np.cumsum(row["sizes"])
                made = [make(ids[b - n : b]) for b, n in zip(stops, row["sizes"])]
                n = len(made)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([row["part"]] * n, pa.int32()), "seq": pa.array([row["seq"]] * n, pa.int32()),
                        "doc_id": pa.array(row["doc_ids"], pa.int64()), "place": pa.array(stops - row["sizes"], pa.int64()),
                        "n_tokens": pa.array(row["sizes"], pa.int64()),
                    }
                    | {k: pa.array([m[k] for m in made]) for k in names}
                )

    found = rows.mapInArrow(run, f"part int, seq int, doc_id long, place long, n_tokens long, {schema}")
    # running totals: within a part over its rows, and over the parts, of which there are as many as tasks
    sizes = rows.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("total"))
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    parts = parts.select("part", (F.sum("total").over(order) - F.col("total")).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq")
    starts = sizes.select("part", "seq", (F.sum("n_ids").over(inside) - F.col("n_ids")).alias("row_start")).join(parts, "part")
    start = (F.col("part_start") + F.col("row_start") + F.col("place")).alias("start")
    return found.join(starts, ["part", "seq"]).select("doc_id", start, "n_tokens", *names)


def id_file(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the ids of ``docs`` to the shared folder and reads size, place and checksum of each document back."""
    path = scratch_path(docs.sparkSession, "ids")
    write_ids(docs, tokenizer, path)
    make = lambda ids: {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}
    return read_ids(docs.sparkSession, path, make, "ids_crc32 long")
