"""Similarity join on word shingles: MinHash candidates, Bayesian pruning, exact verification.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at least
``threshold``. The steps:

1. ``sketch``: per document the hash of its shingle set, and its ``BANDS * ROWS`` MinHash values by bands.
   Texts with equal sets are one node; its hash stands for it from here on, and one of its texts.
2. ``hubs``: nodes that agree on a band of MinHash values meet in that band's bucket. A bucket
   is named by its least member, the hub, so no list of members is ever built. Two members of a bucket
   share the hub in the same band, and only then. At the threshold a pair misses all bands with a chance
   of ``(1 - 0.8 ** 4) ** 32``, 4e-8.
3. ``blocks``: the members of a hub are dealt into cells of bounded size and every two cells form a block,
   so a hub with many members is work for many tasks. A pair is looked at in the block of the least hub
   it shares, once.
4. Within a block, MinHash values are compared ``STEP`` at a time. After each step a pair is dropped if the
   posterior probability of reaching the threshold, under a uniform prior, has fallen below ``tolerance``.
   The pairs that stay are verified on their whole shingle sets.
5. A block returns one row per linked text: copies linked to it, and a link to the least text of its group
   there. Pairs are never rows, so a clique of n near copies costs n rows per block. The links span the
   groups; their connected components are the classes.

A text of 1 to 4 words has one shingle, all its words. Null texts count as empty; empty texts are alike and
form one class. Documents are told apart by ``doc_id``: rows without one are left out. Rows that repeat an id with
different texts are as many nodes, each with its own links; ids come in at the end, where such an id makes the
classes of its texts one and has the links of all of them, counted from text to text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmine.llm.tables import release_memory, with_columns, written
from prefmine.llm.words import mix, shingle_lists, slices

BANDS, ROWS = 32, 4
VALUES = BANDS * ROWS
STEP = 16
CELL_TEXTS, CELL_BYTES = 256, 1 << 20
_SEEDS = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """``VALUES`` 32-bit minima per non-empty set of 64-bit hashes."""
    out = np.full((len(sets), VALUES), 0xFFFFFFFF, np.uint32)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([sets[i] for i in full])
    starts = np.cumsum(sizes[full]) - sizes[full]
    high = np.uint64(32)
    for k in range(VALUES):  # one random linear function of the hash each, its upper half
        values = ((flat * (_SEEDS[2 * k] | np.uint64(1)) + _SEEDS[2 * k + 1]) >> high).astype(np.uint32)
        out[full, k] = np.minimum.reduceat(values, starts)
    return out


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, key of its text, node (hash of its shingle set), size of its text, hashes of its bands of MinHash values."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter("id IS NOT NULL")
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    fields = [T.StructField(n, t) for n, t in (("node", T.LongType()), ("n_bytes", T.LongType()), ("bands", T.ArrayType(T.LongType())))]

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        nodes, n_bytes, bands = [], [], []
        for part in slices(batch.column("text")):
            sets = shingle_lists(part)
            n_bytes += np.diff(part.offsets).tolist()
            values = min_hashes(sets)
            # the set's hash, from its size and two independent sums over its hashes
            sums = np.array([(len(s), mix(s).sum(dtype=np.uint64), mix(s ^ _SEEDS[0]).sum(dtype=np.uint64)) for s in sets], np.uint64).reshape(-1, 3)
            nodes.append(mix(mix(sums[:, 0] + _SEEDS[1]) + mix(sums[:, 1]) + mix(sums[:, 2] ^ _SEEDS[2])).view(np.int64))
            folded = np.zeros((len(sets), BANDS), np.uint64)
            for r in range(ROWS):
                folded = mix(folded + values.reshape(len(sets), BANDS, ROWS)[:, :, r].astype(np.uint64) + np.uint64(r + 1))
            folded[np.fromiter(map(len, sets), np.int64, len(sets)) == 0] = 0
            bands += list(folded.view(np.int64))
        return {"node": pa.array(np.concatenate([np.zeros(0, np.int64), *nodes])), "n_bytes": pa.array(n_bytes, pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64()))}

    return with_columns(rows, make, fields).drop("text")


# --------------------------------------------------------------------------- pruning and verification


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """Matches needed after each ``STEP`` values for a pair to stay.

    With a uniform prior the similarity's posterior after m matches in n is Beta(m + 1, n - m + 1); its
    mass at or above the threshold is the chance of at most m successes in n + 1 trials at the threshold.
    """
    from math import comb

    out = []
    for n in range(STEP, VALUES + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance:
            m += 1
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def _verified(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold on their whole sets.

    Sets are numbered over the block; the shingles that at least two of them hold make the columns of a
    0/1 matrix that is multiplied in strips, or pairs are intersected one by one where they are few.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    shared = np.zeros(len(a), np.int64)
    used = np.unique(np.concatenate([a, b]))
    if len(a) <= 4 * len(used):
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
            both = np.concatenate([sets[x], sets[y]])
            both.sort()
            shared[i] = np.count_nonzero(both[1:] == both[:-1])
    else:
        flat = np.concatenate([sets[i] for i in used])
        owner = np.repeat(np.arange(len(used)), sizes[used])
        _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
        keep = counts[column] >= 2
        owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
        total = np.zeros((len(used), len(used)), np.float32)
        strip = max(1, min((1 << 24) // max(1, len(used)), int(column.max()) + 1 if len(column) else 1))
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, strip):
            lo, hi = np.searchsorted(column, [first, first + strip])
            grid = np.zeros((len(used), strip), np.float32)
            grid[owner[lo:hi], column[lo:hi] - first] = 1
            total += grid @ grid.T
        shared = np.rint(total[np.searchsorted(used, a), np.searchsorted(used, b)]).astype(np.int64)
    # an integer comparison: shared / union >= threshold
    union = sizes[a] + sizes[b] - shared
    return shared >= np.ceil(threshold * union - 1e-9)


def block_links(
    cell: np.ndarray, low: int, high: int, hub: int, minima: np.ndarray, hubs: np.ndarray, met: np.ndarray, sets: list[np.ndarray], threshold: float, tolerance: float
) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of the block of the cells ``low`` and ``high``: of a text of each, or of all texts if they are one
    cell. A cell may be empty; the pairs within the other one are then left to that cell's own block.

    ``hubs`` has the hub of every text in every band, an id of either sign; ``met`` is false where a text is
    alone in its bucket.
    """
    need = least_matches(threshold, tolerance)
    left, right = np.flatnonzero(cell == low), np.flatnonzero(cell == high)
    found_a, found_b = [], []
    width = max(1, (1 << 16) // max(1, len(right)))
    for i in range(0, len(left), width):
        rows = left[i : i + width]
        a, b = np.repeat(rows, len(right)), np.tile(right, len(rows))
        if low == high:
            a, b = a[a < b], b[a < b]
        # the least hub they share must be this block's
        same = (hubs[a] == hubs[b]) & met[a] & met[b]
        least = np.where(same, hubs[a], np.iinfo(np.int64).max).min(1) if len(a) else np.zeros(0, np.int64)
        a, b = a[least == hub], b[least == hub]
        matches = np.zeros(len(a), np.int64)
        for step, least_needed in enumerate(need):
            if not len(a):
                break
            at = slice(step * STEP, (step + 1) * STEP)
            matches = matches + (minima[a, at] == minima[b, at]).sum(1)
            stay = matches >= least_needed
            a, b, matches = a[stay], b[stay], matches[stay]
        if len(a):
            good = _verified(sets, a, b, threshold)
            found_a.append(a[good])
            found_b.append(b[good])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(found_a or empty), np.concatenate(found_b or empty)


def _roots(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id of each text's group under the pairs."""
    label = ids.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        if (new == label).all():
            return label
        label = new


# --------------------------------------------------------------------------- the join


class Join(NamedTuple):
    """``members``: (id, rep), the nodes of every document. ``nodes``: (rep, first, text_key, copies), the least document of a node, the
    key of its text there, and how many documents have it. ``found``: (rep, root, copies), for a text linked in a block the least
    node of its group there and the documents of the nodes that it is linked to."""

    members: DataFrame
    nodes: DataFrame
    found: DataFrame


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, tolerance: float = 1e-6) -> Join:
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter("id IS NOT NULL")
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    sketched = written(sketch(rows, "id", "text").withColumnRenamed("node", "rep"), "sketches")
    members = written(sketched.select("id", "rep").distinct(), "members")
    firsts = members.groupBy("rep").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    known = sketched.withColumnRenamed("id", "first").join(firsts, ["rep", "first"])
    one = F.min(F.struct("text_key", "n_bytes")).alias("one")
    reps = known.groupBy("rep").agg(F.first("first").alias("first"), F.first("copies").alias("copies"), one, F.first("bands").alias("bands"))
    reps = written(reps.select("rep", "first", "copies", "one.text_key", "one.n_bytes", "bands"), "nodes")
    banded = reps.select("rep", F.posexplode("bands").alias("band", "hash")).filter("hash <> 0")
    buckets = banded.groupBy("band", "hash").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    placed = banded.join(buckets, ["band", "hash"]).groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("band", "hub"))).alias("hubs"))
    placed = written(placed.join(reps.drop("bands"), "rep"), "hubs")

    sent = placed.select("rep", "n_bytes", F.explode(F.array_distinct(F.map_values("hubs"))).alias("hub"))
    cells = sent.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("total"))
    cells = cells.filter("n > 1").select("hub", F.greatest(F.ceil(F.col("n") / CELL_TEXTS), F.ceil(F.col("total") / CELL_BYTES)).cast("int").alias("k"))
    dealt = sent.join(cells, "hub").withColumn("cell", F.pmod(F.xxhash64("rep", "hub"), F.col("k")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pairs = pairs.select("rep", "hub", "cell", F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high"))

    # the hint makes the join the same at every size: the texts are dealt by id, a broadcast would grow with the groups
    wanted = placed.select("rep", F.col("first").alias("id"), "text_key").hint("shuffle_merge")
    texts = keyed.hint("shuffle_merge").join(wanted, ["id", "text_key"]).groupBy("rep").agg(F.first("text").alias("text"))
    full = placed.select("rep", "copies", "hubs").join(texts, "rep")
    work = pairs.join(full, "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        n = table.num_rows
        ids, cell = table["rep"].to_numpy(), table["cell"].to_numpy()
        hub, low, high = (int(table[c][0].as_py()) for c in ("hub", "low", "high"))
        copies = table["copies"].to_numpy()
        hubs, met = np.zeros((n, BANDS), np.int64), np.zeros((n, BANDS), bool)
        for i, found in enumerate(table["hubs"].to_pylist()):
            for band, h in found:
                hubs[i, band], met[i, band] = h, True
        sets = [s for part in slices(table["text"]) for s in shingle_lists(part)]
        minima = min_hashes(sets)  # anew: cheaper than sending 512 bytes of them for each text
        a, b = block_links(cell, low, high, hub, minima, hubs, met, sets, threshold, tolerance)
        release_memory()
        if not len(a):
            return
        linked = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
        roots = _roots(n, a, b, ids)
        at = np.flatnonzero(linked)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[at], pa.int64()), pa.array(roots[at], pa.int64()), pa.array(linked[at].astype(np.int64), pa.int64())], ["rep", "root", "copies"]
        )

    found = work.groupBy("hub", "low", "high").applyInArrow(run, "rep long, root long, copies long")
    return Join(members, reps.select("rep", "first", "text_key", "copies"), written(found, "links"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component of the rows (a, b).

    Every round each node takes the least label among its neighbours and itself, and then the label of
    that label, so chains shrink fast. Labels are written to shared storage each round.
    """
    both = written(edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("new"))
        jump = stepped.select(F.col("node").alias("new"), F.col("new").alias("far"))
        nexts = stepped.join(jump, "new", "left").select("node", F.col("label").alias("old"), F.coalesce("far", "new").alias("label"))
        nexts = written(nexts, "labels")
        labels = nexts.select("node", "label")
        if not nexts.filter("old <> label").limit(1).count():
            return labels


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, tolerance: float = 1e-6) -> DataFrame:
    """Per document ``doc_id``, ``class_id`` (least id of its class) and ``n_links``: other documents at or
    above the threshold. A class is a connected component of links; the texts of one id are in one class, and its links
    are those of all its texts."""
    join = links(docs, doc_id, text, threshold, tolerance)
    several = join.members.groupBy("id").agg(F.min("rep").alias("root"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    merged = join.members.join(several, "id").select("rep", "root")
    labels = components(join.found.select("rep", "root").unionByName(merged).select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    least = labels.join(join.nodes, "rep").groupBy("label").agg(F.min("first").alias("least"))
    counts = join.found.groupBy("rep").agg(F.sum("copies").alias("linked"))
    known = join.nodes.join(labels.join(least, "label").select("rep", "least"), "rep", "left").join(counts, "rep", "left")
    known = known.select("rep", F.coalesce("least", "first").alias("class_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    found = join.members.join(known, "rep").groupBy(F.col("id").alias("doc_id"))
    return found.agg(F.min("class_id").alias("class_id"), F.sum("n_links").cast("bigint").alias("n_links"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row of every class of texts, with all columns: the one with the least id, then the least hash of its text. An id with texts
    that are not alike keeps a row for each. Rows without an id stay."""
    join = links(docs, doc_id, text, threshold)
    labels = components(join.found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    own = join.nodes.join(labels, "rep", "left").groupBy(F.coalesce("label", "rep").alias("label")).agg(F.min(F.struct("first", "text_key")).alias("kept"))
    kept = own.select(F.col("kept.first").alias("__kept"), F.col("kept.text_key").alias("__key"))
    known = docs.withColumns({"__id": F.col(doc_id).cast("bigint"), "__text": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    known = known.join(kept, (F.col("__id") == F.col("__kept")) & (F.col("__text") == F.col("__key")))
    plain = [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    same = Window.partitionBy("__kept", "__key").orderBy(F.xxhash64(*[F.col(c) for c in plain]))
    known = known.withColumn("__n", F.row_number().over(same)).filter("__n = 1").select(*[known[c] for c in docs.columns])
    return known.unionByName(docs.filter(F.col(doc_id).isNull()))
