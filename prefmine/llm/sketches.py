"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the ``k`` smallest of the 48-bit hashes of a text's distinct five-word shingles.
The sketch of a union of texts is the bottom k of their sketches, so parts can be merged in any
order. Likeness, containment and the number of distinct shingles are estimated from it; a text with
at most ``k`` shingles gives exact values. Null texts count as empty. The sketch of an empty text is
empty; two empty sketches are alike (1), an empty and a full one are not (0). Equal texts have equal
sketches. Repeated rows are fingerprinted each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmine.core import top_per_key
from prefmine.llm.tables import with_columns
from prefmine.llm.words import shingle_lists, slices

K = 256
BITS = 48


def sketches(texts: pa.Array, k: int = K) -> list[np.ndarray]:
    """Sorted bottom-k hashes of each text."""
    drop = np.uint64(64 - BITS)
    return [np.unique(s >> drop)[:k] for part in slices(texts) for s in shingle_lists(part)]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of shingles of either text that both have."""
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    twice = both[:-1] == both[1:]  # a value is at most once in each sketch
    total = len(both) - int(twice.sum())
    if total <= k:
        return float(twice.sum()) / total
    distinct = np.ones(len(both), bool)
    distinct[1:] = ~twice
    last = both[distinct][k - 1]
    return float((twice & (both[1:] <= last)).sum()) / k


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << BITS) / (float(a[k - 1]) + 1.0)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has too."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return min(1.0, shared / distinct_count(a, k))


def as_text(sketch: np.ndarray) -> str:
    """Base64 of the hashes, six bytes each."""
    raw = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return base64.b64encode(raw.tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).reshape(-1).view(">u8").astype(np.uint64)


def fingerprints(df: DataFrame, text: str = "text", out: str = "sketch", k: int = K) -> DataFrame:
    """Appends the sketch of ``text`` as an array of longs."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        found = [s.astype(np.int64) for s in sketches(batch.column(text), k)]
        return {out: pa.array(found, pa.list_(pa.int64()))}

    return with_columns(df, make, [T.StructField(out, T.ArrayType(T.LongType()))])


def merged(df: DataFrame, keys: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per key from those of its rows.

    Hashes are cut to the k smallest per key inside each task before the shuffle, so a hot key sends
    k hashes per task. Keys that only have empty sketches are left out.
    """
    hashes = df.select(*keys, F.explode(sketch).alias("__h")).distinct()
    return top_per_key(hashes, keys, [F.col("__h")], k).groupBy(*keys).agg(F.array_sort(F.collect_list("__h")).alias(sketch))


def _bucket(value, cuts: list[int]):
    """Number of cut points below ``value``, found in two steps of about sqrt(n) comparisons."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    array = lambda xs: F.lit(xs).cast("array<bigint>") if xs else F.array().cast("array<bigint>")
    coarse = F.size(F.filter(array(cuts[step - 1 :: step]), lambda c: c < value))
    fine = F.size(F.filter(F.slice(array(cuts), coarse * step + 1, F.lit(step)), lambda c: c < value))
    return coarse * step + fine


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (bucket, head, id, text) in partitions whose neighbours in order are neighbouring documents.

    Documents are dealt into ranges of ids, each sorted by descending id; every range ends with a copy
    of the first document of the range that follows (``head``), after the last comes the first. So a
    range is complete without looking at another. Unknown ids come last; equal ids are ordered by text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = F.coalesce("id", F.lit(-(1 << 63)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    cuts = sorted(set(found or []))
    rows = rows.withColumn("bucket", _bucket(key, cuts))
    firsts = rows.groupBy("bucket").agg(F.max(F.struct(key.alias("key"), "text", "id")).alias("first"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("bucket"))  # one row per range
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("first").over(order), F.first("first").over(whole))
    heads = firsts.select("bucket", after.alias("first")).select("bucket", F.lit(True).alias("head"), F.col("first.id").alias("id"), F.col("first.text").alias("text"))
    both = rows.select("bucket", F.lit(False).alias("head"), "id", "text").unionByName(heads)
    return both.repartition(parts, "bucket").sortWithinPartitions("bucket", "head", F.desc_nulls_last("id"), F.desc("text"))


def _edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


REPORT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double"


def edit_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has the last third replaced by as many first characters of the next document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (id, text, sketch) of a document whose follower is not seen yet
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts, found = part.column("text").to_pylist(), sketches(part.column("text"), k)
                pairs = []
                for head, i, t, s in zip(part.column("head").to_pylist(), part.column("id").to_pylist(), texts, found):
                    if held is not None:
                        pairs.append((*held, t, s))
                    held = None if head else (i, t, s)
                if not pairs:
                    continue
                changed = [_edited(p[1], p[3]) for p in pairs]
                other = sketches(pa.array(changed, pa.large_string()), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p[0] for p in pairs], pa.int64()),
                        pa.array([len(p[1]) for p in pairs], pa.int64()),
                        pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed]),
                        pa.array([as_text(p[2]) for p in pairs]),
                        pa.array([as_text(s) for s in other]),
                        pa.array([resemblance(p[2], s, k) for p, s in zip(pairs, other)]),
                        pa.array([resemblance(p[2], p[4], k) for p in pairs]),
                        pa.array([distinct_count(p[2], k) for p in pairs]),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_shingles"],
                )

    return with_next(docs, doc_id, text).mapInArrow(run, REPORT)
