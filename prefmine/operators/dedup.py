"""Near-duplicate detection by 64-bit signatures."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmine.core import null_safe_join, stored


def previous_in_order(df: DataFrame, group: list[str], bucket: Column, order: list[str], take: dict[str, str]) -> DataFrame:
    """Adds values of the preceding row of the group, like ``lag``, without one task per group.

    ``bucket`` grows with ``order``. Rows look back inside their bucket; the first row of a bucket
    takes its values from the last row of the nearest bucket before it, found in a table with one
    row per (group, bucket).
    """
    rows = df.withColumn("__bucket", bucket)
    last = rows.groupBy(*group, "__bucket").agg(F.max(F.struct(*order, *[c for c in take.values() if c not in order])).alias("__last"))
    across = Window.partitionBy(*group).orderBy("__bucket")
    edges = last.select(*group, "__bucket", F.lag("__last").over(across).alias("__edge"))
    inside = Window.partitionBy(*group, "__bucket").orderBy(*order)
    looked = rows.withColumn("__row", F.row_number().over(inside))
    for out, source in take.items():
        looked = looked.withColumn(out, F.lag(source).over(inside))
    joined = null_safe_join(looked, edges, [*group, "__bucket"])
    for out, source in take.items():
        joined = joined.withColumn(out, F.when(F.col("__row") == 1, F.col(f"__edge.{source}")).otherwise(F.col(out)))
    return joined.drop("__bucket", "__row", "__edge")


def simhash(df: DataFrame, key: str, text: Column, min_chars: int = 20) -> DataFrame:
    """(key, signature): 64 majority votes over the words of a text, 0 for texts that are too short.

    A word votes with the first eight bytes of its MD5, lowest byte and lowest bit first. The votes of a text are added up
    in its Arrow batch, a stretch of words at a time; no word becomes a row.
    """
    clean = F.trim(F.regexp_replace(F.lower(F.trim("__text")), r"\s+", " "))
    texts = df.select(key, text.alias("__text")).select(key, clean.alias("__clean"))
    texts = texts.select(key, F.when(F.length("__clean") >= min_chars, F.col("__clean")).alias("__clean"))
    schema = T.StructType([texts.schema[key], T.StructField("signature", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        for batch in batches:
            signatures = np.zeros(len(batch), np.uint64)
            for at, clean_text in enumerate(batch.column("__clean")):
                if clean_text.is_valid:
                    signatures[at] = _majority(clean_text.as_py().split(" "), known)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(signatures.view(np.int64))], [key, "signature"])

    return texts.mapInArrow(run, schema)


def _majority(words: list[str], known: dict[str, bytes], stretch: int = 1 << 15, held: int = 1 << 18) -> np.uint64:
    """Bits set in more than half of the words' hashes; ``known`` keeps the hashes of words met before."""
    votes = np.zeros(64, np.int64)
    for first in range(0, len(words), stretch):
        some = words[first : first + stretch]
        if len(known) > held:
            known.clear()
        for word in some:
            if word not in known:
                known[word] = md5(word.encode()).digest()[:8]
        hashes = np.frombuffer(b"".join([known[w] for w in some]), np.uint8).reshape(-1, 8)
        votes += np.unpackbits(hashes, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(words), bitorder="little").view(np.uint64)[0]


def near_duplicates(signed: DataFrame, category: str, key: str, max_distance: int = 3, strict: bool = False) -> DataFrame:
    """Keys of rows whose signature is within ``max_distance`` bits of the one before it in its category.

    Rows are in unsigned order of signature, equal ones by key. Equal signatures are one group:
    all but the first row are duplicates, and only the group as such is compared with the group
    before it, so a text copied a billion times is one row here. Signature 0 (short texts) takes
    part only with ``strict``.
    """
    rows = signed if strict else signed.filter(F.col("signature") != 0)
    groups = rows.groupBy(category, "signature").agg(F.min(key).alias("__first"), F.count(F.lit(1)).alias("__n"))
    unsigned = F.col("signature").bitwiseXOR(F.lit(-(1 << 63)))
    groups = groups.withColumn("__order", unsigned)
    placed = previous_in_order(groups, [category], F.shiftright("__order", 50), ["__order"], {"__prev": "signature"})
    near = F.coalesce(F.bit_count(F.col("signature").bitwiseXOR(F.col("__prev"))) <= max_distance, F.lit(False))
    hits = placed.withColumn("__near", near).filter(F.col("__near") | (F.col("__n") > 1))
    joined = null_safe_join(rows, hits.select(category, "signature", "__first", "__near"), [category, "signature"], "inner")
    return joined.filter(F.col("__near") | (F.col(key) != F.col("__first"))).select(category, key)


# --------------------------------------------------------------------------- all pairs within three bits, by bands

BANDS, BAND_BITS = 4, 16


def band_links(signed: DataFrame, key: str, max_distance: int = 3, strict: bool = False, cell: int = 2048, shard: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(nodes, found) of all signatures within ``max_distance`` bits of each other, wherever they stand in order.

    Two signatures that differ in at most three bits agree on one of four bands of 16 bits, so only signatures that share a
    band's value are compared. Equal signatures are one node (signature, first, copies). The members of a value are dealt into
    cells of about ``cell`` and every two cells form a block, so a hot value is work for many tasks; small values share a
    block by shards. A pair counts in the first band it agrees on. ``found`` has one row (signature, root, linked) per
    linked signature and block: rows it is linked to, and the least signature of its group there; pairs are never rows.
    """
    if not 0 <= max_distance < BANDS:
        raise ValueError("four bands find pairs within three bits")
    rows = signed if strict else signed.filter(F.col("signature") != 0)
    nodes = stored(rows.groupBy("signature").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies")), "signatures")
    shards = max(1, -(-nodes.count() // shard))
    values = F.array(*[F.shiftrightunsigned("signature", BAND_BITS * b).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int") for b in range(BANDS)])
    banded = nodes.select("signature", "copies", F.posexplode(values).alias("band", "value"))
    sizes = banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    dealt = banded.join(sizes.select("band", "value", F.ceil(F.col("n") / cell).cast("int").alias("cells")), ["band", "value"])
    dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("signature"), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    # a value that fills several cells is a block's own; those of one cell share
    place = F.when(F.col("cells") > 1, F.col("value")).otherwise(-1 - F.pmod(F.hash("value"), F.lit(shards)))
    blocks = dealt.select("signature", "copies", "band", "value", "cell", place.alias("place"), F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(list(batches)).sort_by("value")
        signature, copies, value, cells = (block[c].to_numpy() for c in ("signature", "copies", "value", "cell"))
        band, low, high = (block[c][0].as_py() for c in ("band", "low", "high"))
        bits = signature.view(np.uint64)
        ends = np.flatnonzero(np.append(value[1:] != value[:-1], True)) + 1
        linked, label = np.zeros(len(bits), np.int64), signature.copy()
        ones, others = [], []
        for first, end in zip(np.concatenate([[0], ends[:-1]]), ends):
            left, right = (first + np.flatnonzero(cells[first:end] == c) for c in (low, high))
            for i in left:
                them = right[right > i] if low == high else right
                differ = bits[i] ^ bits[them]
                near = np.bitwise_count(differ) <= max_distance
                for earlier in range(band):
                    near &= (differ >> np.uint64(BAND_BITS * earlier)) & np.uint64((1 << BAND_BITS) - 1) != 0
                if near.any():
                    them = them[near]
                    linked[i] += copies[them].sum()
                    linked[them] += copies[i]
                    ones.append(np.full(len(them), i))
                    others.append(them)
        if not ones:
            return
        a, b = np.concatenate(ones), np.concatenate(others)
        while True:
            new = label.copy()
            np.minimum.at(new, a, label[b])
            np.minimum.at(new, b, label[a])
            if (new == label).all():
                break
            label = new
        at = np.flatnonzero(linked)
        yield pa.RecordBatch.from_arrays([pa.array(signature[at]), pa.array(label[at]), pa.array(linked[at])], ["signature", "root", "linked"])

    found = blocks.groupBy("band", "place", "low", "high").applyInArrow(run, "signature long, root long, linked long")
    return nodes, stored(found, "links")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): the least node of each connected component. Labels are stored each round, and jump
    to the label of their label, so long chains take few rounds."""
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("near")).filter("node <> near")
    pairs = stored(pairs.unionByName(pairs.select(F.col("near").alias("node"), F.col("node").alias("near"))).distinct(), "edges")
    labels = stored(pairs.groupBy("node").agg(F.least("node", F.min("near")).alias("label")), "labels")
    while True:
        around = pairs.join(labels.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.min("label").alias("around"))
        least = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "around").alias("via"))
        jump = least.select(F.col("node").alias("via"), F.col("via").alias("far"))
        moved = stored(least.join(jump, "via", "left").select("node", "old", F.coalesce("far", "via").alias("label")), "labels")
        labels = moved.select("node", "label")
        if not moved.filter("old <> label").limit(1).count():
            return labels


def band_classes(signed: DataFrame, key: str, max_distance: int = 3, strict: bool = False, **sizes) -> DataFrame:
    """(key, class_id, n_links) of every row with a signature: the least key of its class, and the other rows within
    ``max_distance`` bits of it. A class is a connected component of these links."""
    nodes, found = band_links(signed, key, max_distance, strict, **sizes)
    labels = components(found, "signature", "root").withColumnRenamed("node", "signature")
    least = labels.join(nodes, "signature").groupBy("label").agg(F.min("first").alias("least"))
    counts = found.groupBy("signature").agg(F.sum("linked").alias("linked"))
    known = nodes.join(labels.join(least, "label").select("signature", "least"), "signature", "left").join(counts, "signature", "left")
    known = known.select("signature", F.coalesce("least", "first").alias("class_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return signed.join(known, "signature").select(key, "class_id", "n_links")


def duplicate_rates(signed: DataFrame, duplicates: DataFrame, category: str) -> DataFrame:
    """Rows, duplicates and rate per category."""
    n = signed.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    dups = duplicates.groupBy(category).agg(F.count(F.lit(1)).alias("dups"))
    out = n.join(dups, category, "left").withColumn("dups", F.coalesce("dups", F.lit(0)))
    return out.withColumn("rate", F.col("dups") * 100.0 / F.col("n"))


def without_duplicates(df: DataFrame, duplicates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rows that are not duplicates, with the output columns."""
    return df.join(duplicates.select(key), key, "left_anti").select(*columns)
