"""Language-model scoring: hashed maximum-entropy model with a class-factored softmax.

Tokens are lower-cased (A-Z) words and one end per text. The model is
``P(token | history) = P(class | history) * P(cell | class, history) * P(token | cell)``.

- Classes: each of the ``HEADS`` most frequent training words is a class of its own, and so is the end.
  Every other token belongs to the group of a head: the commonest frequent word of a text in which it
  occurs, taken in the block with most of its occurrences. So groups follow language and subject.
- ``P(class | history)`` is a softmax over the classes of the sum of hashed features' weights: the previous
  token, the previous two together (n-grams), the token before the previous one and the third before
  (skips), and a bias. Each template hashes into its own ``BUCKETS`` rows.
- ``P(cell | class, history)``: the ``OWN`` most frequent tokens of a group are a cell each, all others are dealt by hash
  into ``CELLS - OWN`` shared ones. A second softmax over the cells of a group sums the weights of the same n-gram
  and skip features, each taken together with the group, in ``inner_buckets`` rows per template, which grow with the training tokens. So history chooses
  among some 400 words, as words, and among the shared cells for the rest. Classes of one token have one cell.
- ``P(token | cell)`` is the cell's maximum-entropy distribution under its token counts, discounted absolutely, and does
  not depend on the history. What the discount takes off a class is the mass of the unknown token in it. So the
  probabilities over all known tokens and the one unknown token sum to one, over the same events as the base score's.

Texts are tokenised once, in blocks of at most ``BLOCK_BYTES``: a block's texts become places in the
block's own list of distinct tokens. These lists are shuffled by token to give each entry its training
total and class, and then by block, where they meet the block's texts: the vocabulary is never held or
sent whole. Texts are then stored as class numbers, cells and 16-bit token hashes. Training goes over all
training texts, a third of them in each round: every task starts from the round's weights and makes
mini-batch gradient steps over its part; changes are averaged per weight row over the tasks that made
any. The class weights have ``TEMPLATES * BUCKETS`` rows of ``CLASSES`` floats (4 MB), whatever the data; rows of cells, and the tokens
that a training task takes, both grow with the cube root of the training tokens, so that what tasks send stays in proportion to
the input: 4 MB of cells up to 67 million tokens, 16 MB at 4 billion, 256 MB at 17 trillion. Weights, head words, the most frequent tokens
of the groups and totals per cell are all that passes the driver.

Null texts count as empty: their only token is the end. A null id counts as an empty text for the fold.
Repeated rows are scored, and learned from, each. Without training texts all scores are those of a
uniform model over one unknown token and the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefmine.core import top_per_key
from prefmine.llm.tables import written
from prefmine.llm.words import slices, words_of

HEADS = 31
CLASSES = 2 * HEADS + 2  # heads, groups of other tokens by head, tokens without a head, the end
LOOSE, ENDING, UNKNOWN = 2 * HEADS, 2 * HEADS + 1, 255
BUCKETS = 1 << 12
TEMPLATES = 4
ROWS_EACH = 256  # weight rows that travel together
OWN, CELLS = 12, 16  # tokens of a group with a cell of their own, all its cells
INNER_BUCKETS = 1 << 14  # rows of cells per template for up to GROWS_FROM training tokens
GROWS_FROM = 1 << 26
TASK_TOKENS = 3 << 19  # of a training task, for up to GROWS_FROM training tokens
NEAR = 512  # tokens whose logits stay in a core's cache
END = np.uint64(0x5851F42D4C957F2D)
BLOCK_BYTES = 12 << 20
FREQUENT = 64  # of a block's tokens, those that can be the head of a text

BLOCK_ROW = "kind int, block long, doc_id long, held_out boolean, n int, ids binary, place int, token long, head long"
TEXT_ROW = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inside double, classes binary, cells binary, hashes binary"


class Totals(NamedTuple):
    """Of the training tokens: count, distinct tokens, the discount, count and distinct tokens of each class and of each of its cells."""

    tokens: int
    distinct: int
    discount: float
    class_tokens: np.ndarray
    class_distinct: np.ndarray
    cell_tokens: np.ndarray
    cell_distinct: np.ndarray

    @property
    def unknown_share(self) -> np.ndarray:
        """Probability of the unknown token in each class."""
        share = self.discount * self.class_distinct / np.maximum(self.class_tokens, 1)
        share[:HEADS] = share[ENDING] = 0
        return share

    @property
    def growth(self) -> int:
        """Cube root of the training tokens over ``GROWS_FROM``, as the next power of two, 1 at least."""
        return 1 << max(0, math.ceil(math.log2(max(self.tokens, 1) / GROWS_FROM) / 3))

    @property
    def inner_buckets(self) -> int:
        return INNER_BUCKETS * self.growth

    def inside(self, c: np.ndarray, kind: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """log10 P(token | cell), and that it is a known one, of tokens with training counts ``c``; 0 for unknown tokens."""
        out = np.zeros(len(c))
        at = np.flatnonzero((kind >= HEADS) & (kind <= LOOSE) & (c > 0))
        k, e = kind[at], cell[at]
        rest = self.cell_tokens[k, e] - self.discount * self.cell_distinct[k, e]
        out[at] = np.log10(1 - self.unknown_share[k]) + np.log10((c[at] - self.discount) / rest)
        return out


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


# --------------------------------------------------------------------------- blocks


def _block_rows(block: int, ids: list, held: list, sizes: np.ndarray, tokens: np.ndarray) -> pa.Table:
    """Rows of kind 0 (texts as places in the block's list) and of kind 1 (the list, with training counts)."""
    names = [f.split()[0] for f in BLOCK_ROW.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64()]
    distinct, first, places, total = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
    # the most frequent come first, so that places are small numbers
    order = np.argsort(-total, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    places = rank[places].astype(np.int32)
    distinct = distinct[order]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    learned = ~np.array(held, bool)
    counts = np.bincount(places, learned[doc], len(distinct)).astype(np.int32)
    # the head of each text: the most common of the block's frequent words in it
    end = np.flatnonzero(distinct[:FREQUENT] == END)
    low = np.flatnonzero(places < FREQUENT)
    grid = np.bincount(doc[low] * FREQUENT + places[low], minlength=len(sizes) * FREQUENT).reshape(-1, FREQUENT)
    grid[:, end] = 0
    best = grid.argmax(1)
    head = np.where(grid.max(1, initial=0) > 0, distinct[np.minimum(best, len(distinct) - 1)], 0)
    # of each token, the head of the first training text that has it
    inside = np.flatnonzero(learned[doc])
    seen = np.zeros(len(distinct), np.uint64)
    seen[places[inside[::-1]]] = head[doc[inside[::-1]]]
    stops = np.cumsum(sizes)
    texts = [_packed(places[b - n : b]) for b, n in zip(stops, sizes)]
    nothing = lambda n, t: pa.nulls(n, t)
    n, m = len(sizes), len(distinct)
    rows = [
        [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, block)), pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(sizes.astype(np.int32)), pa.array(texts, pa.binary()), nothing(n, types[6]), nothing(n, types[7]), nothing(n, types[8])],
        [pa.array(np.ones(m, np.int32)), pa.array(np.full(m, block)), nothing(m, types[2]), nothing(m, types[3]), pa.array(counts), nothing(m, types[5]), pa.array(np.arange(m, dtype=np.int32)), pa.array(distinct.view(np.int64)), pa.array(seen.view(np.int64))],
    ]
    return pa.concat_tables([pa.Table.from_arrays([c.cast(t) for c, t in zip(r, types)], names) for r in rows])


def blocks(docs: DataFrame) -> DataFrame:
    """Block rows of documents (doc_id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        ids: list = []
        held: list = []
        sizes: list[np.ndarray] = []
        tokens: list[np.ndarray] = []
        filled = 0
        for batch in batches:
            names, out = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
            for part in slices(batch.column("text")):
                if filled + len(part.data) > BLOCK_BYTES and ids:
                    yield from _block_rows(block, ids, held, np.concatenate(sizes), np.concatenate(tokens)).to_batches(50_000)
                    block, ids, held, sizes, tokens, filled = block + 1, [], [], [], [], 0
                found = words_of(part, lower=True)
                n = np.bincount(found.doc, minlength=len(part.offsets) - 1)
                tokens.append(np.insert(found.hash, np.cumsum(n), END))
                sizes.append(n + 1)
                ids += names[part.first : part.first + len(n)]
                held += out[part.first : part.first + len(n)]
                filled += len(part.data)
        if ids:
            yield from _block_rows(block, ids, held, np.concatenate(sizes), np.concatenate(tokens)).to_batches(50_000)

    return docs.mapInArrow(run, BLOCK_ROW)


def with_totals(rows: DataFrame) -> tuple[DataFrame, Totals]:
    """(entries, totals): of every entry of every block's list its training count ``c`` and its class."""
    entries = rows.filter("kind = 1").select("block", "place", "token", "n", "head")
    same = Window.partitionBy("token")
    counted = entries.withColumns(
        {
            "c": F.sum("n").over(same), "group": F.max(F.struct("n", "head")).over(same)["head"],
            "own": F.col("block") == F.min("block").over(same),
        }
    )
    counted = written(counted.select("block", "place", "token", "c", "group", "own"), "entries")
    end = int(END.astype(np.int64))
    words = counted.filter((F.col("token") != end) & F.col("own") & (F.col("c") > 0))
    heads = [r["token"] for r in words.orderBy(F.desc("c"), "token").limit(HEADS).select("token").collect()]
    own = F.create_map(*[x for i, h in enumerate(heads) for x in (F.lit(h), F.lit(i))]) if heads else F.lit(None).cast("map<bigint,int>")
    kind = F.when(F.col("c") == 0, UNKNOWN).when(F.col("token") == end, ENDING)
    kind = F.coalesce(kind, F.try_element_at(own, "token"), F.try_element_at(own, "group") + HEADS, F.lit(LOOSE)).cast("int")
    counted = counted.withColumn("class", kind)
    grouped = counted.filter(F.col("own") & F.col("class").between(HEADS, LOOSE)).select("class", "token", "c")
    # at most OWN tokens of every group
    first = top_per_key(grouped, ["class"], [F.desc("c"), F.col("token")], OWN).select("class", "token", "c").collect()
    first.sort(key=lambda r: (r["class"], -r["c"], r["token"]))
    own_cell, place = [], dict.fromkeys(range(CLASSES), 0)
    for r in first:
        own_cell.append((r["token"], place[r["class"]]))
        place[r["class"]] += 1
    own_cells = rows.sparkSession.createDataFrame(own_cell, "token bigint, own_cell int")
    in_group = F.col("class").between(HEADS, LOOSE)
    shared = F.lit(OWN) + F.pmod(F.col("token"), F.lit(CELLS - OWN)).cast("int")
    counted = counted.join(F.broadcast(own_cells), "token", "left").withColumn("cell", F.when(in_group, F.coalesce("own_cell", shared)).otherwise(0))
    known = counted.filter(F.col("own") & (F.col("c") > 0)).groupBy("class", "cell").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")
    ).collect()  # a row per cell
    cell_tokens, cell_distinct = np.zeros((CLASSES, CELLS)), np.zeros((CLASSES, CELLS))
    for r in known:
        cell_tokens[r["class"], r["cell"]], cell_distinct[r["class"], r["cell"]] = r["n"], r["v"]
    tokens, distinct = cell_tokens.sum(1), cell_distinct.sum(1)
    once, twice = sum(r["n1"] for r in known), sum(r["n2"] for r in known)
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    totals = Totals(int(tokens.sum()), int(distinct.sum()), discount, tokens, distinct, cell_tokens, cell_distinct)
    short = F.col("token").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("short")  # all that the features need of it
    return counted.select("block", "place", short, "c", "class", "cell"), totals


def encoded(rows: DataFrame, entries: DataFrame, totals: Totals) -> DataFrame:
    """Texts as classes, cells and token hashes, with the base score and the score inside cells."""
    norm = totals.tokens + 0.5 * (totals.distinct + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        at = left["place"].to_numpy()
        c, kind, cell, short = np.zeros(n, np.int64), np.zeros(n, np.uint8), np.zeros(n, np.uint8), np.zeros(n, np.uint16)
        cell[at] = left["cell"].to_numpy().astype(np.uint8)
        c[at], kind[at] = left["c"].to_numpy(), left["class"].to_numpy().astype(np.uint8)
        short[at] = left["short"].to_numpy().astype(np.uint16)
        base = np.log10((c + 0.5) / norm)
        inside = totals.inside(c, kind, cell)
        out: dict[str, list] = {f.split()[0]: [] for f in TEXT_ROW.split(", ")}
        for row in right.select(["doc_id", "held_out", "n", "ids"]).to_pylist():
            places = _unpacked(row["ids"], np.int32, row["n"])
            values = (row["doc_id"], row["held_out"], row["n"], int((c[places] > 0).sum()), float(base[places].sum()), float(inside[places].sum()), _packed(kind[places]), _packed(cell[places]), _packed(short[places]))
            for name, value in zip(out, values):
                out[name].append(value)
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types)})

    texts = rows.filter("kind = 0").select("block", "doc_id", "held_out", "n", "ids")
    return entries.groupBy("block").cogroup(texts.groupBy("block")).applyInArrow(run, TEXT_ROW)


# --------------------------------------------------------------------------- the model of classes and cells


def histories(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """The history of every token as each template sees it; no history crosses a text's start."""
    n = len(hashes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(n) - np.repeat(starts, sizes)
    before = []
    for back in (1, 2, 3):
        past = np.zeros(n, np.uint32)
        past[back:] = hashes[: n - back].astype(np.uint32) + np.uint32(1)
        past[place < back] = 0
        before.append(past)
    one, two, three = before
    return one, one * np.uint32(0x9E3779B1) + two * np.uint32(0x85EBCA77), two + np.uint32(0x20000), three + np.uint32(0x40000)


def hashed(mixed: Iterable[np.ndarray], buckets: int) -> np.ndarray:
    """Weight rows, one column per template; ``buckets`` is a power of two."""
    down = np.uint32(32 - buckets.bit_length() + 1)
    spread = [((m ^ (m >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> down).astype(np.int64) for m in mixed]
    return np.stack([s + i * buckets for i, s in enumerate(spread)], axis=1)


def feature_rows(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Weight rows of the class features of every token."""
    return hashed(histories(hashes, sizes), BUCKETS)


def cell_rows(past: tuple[np.ndarray, ...], at: np.ndarray, classes: np.ndarray, buckets: int) -> np.ndarray:
    """Weight rows of the cell features of the tokens ``at``: of their histories together with their classes."""
    own = (classes.astype(np.uint32) + np.uint32(1)) * np.uint32(0xC2B2AE35)
    return hashed([(m[at] ^ own) * np.uint32(0x27D4EB2F) for m in past], buckets)


def log_probabilities(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.empty((len(rows), weights.shape[1]), np.float32)
    for i in range(0, len(rows), NEAR):
        at = slice(i, i + NEAR)
        logits = np.take(weights, rows[at, 0], axis=0, out=out[at], mode="clip")
        more = np.empty_like(logits)
        for t in range(1, TEMPLATES):
            logits += np.take(weights, rows[at, t], axis=0, out=more, mode="clip")
        logits += bias if bias.ndim == 1 else bias[at]
        logits -= logits.max(1, keepdims=True)
        logits -= np.log(np.exp(logits, out=more).sum(1, keepdims=True))
    return out


def gradient_steps(weights: np.ndarray, bias: np.ndarray, squares: np.ndarray, rows: np.ndarray, classes: np.ndarray, rate: float) -> None:
    """One mini-batch: every weight row moves against the mean gradient of its tokens, by AdaGrad."""
    gradient = np.exp(log_probabilities(weights, bias, rows))
    gradient[np.arange(len(classes)), classes] -= 1
    flat, columns = gradient.astype(np.float64).ravel(), np.arange(CLASSES)
    for t in range(TEMPLATES):
        own = rows[:, t] - t * BUCKETS
        cells = np.add.outer(own * CLASSES, columns).ravel()
        step = np.bincount(cells, flat, BUCKETS * CLASSES).astype(np.float32).reshape(BUCKETS, CLASSES)
        at = slice(t * BUCKETS, (t + 1) * BUCKETS)
        squares[at] += np.einsum("ij,ij->i", step, step) / CLASSES
        step *= (rate / np.sqrt(squares[at] + 1e-3))[:, None]
        weights[at] -= step


def cell_steps(weights: np.ndarray, bias: np.ndarray, squares: np.ndarray, rows: np.ndarray, cells: np.ndarray, rate: float) -> None:
    """The like for cells, with a bias per token, moving only the rows that the mini-batch meets."""
    gradient = np.exp(log_probabilities(weights, bias, rows))
    gradient[np.arange(len(cells)), cells] -= 1
    for t in range(TEMPLATES):
        order = np.argsort(rows[:, t], kind="stable")
        ids = rows[order, t]
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        step, at = np.add.reduceat(gradient[order], starts, axis=0), ids[starts]
        squares[at] += np.einsum("ij,ij->i", step, step) / CELLS
        weights[at] -= step * (rate / np.sqrt(squares[at] + 1e-3))[:, None]


def _grouped(classes: np.ndarray) -> np.ndarray:
    """Places of the tokens that are in a group, and so in one of several cells."""
    return np.flatnonzero((classes >= HEADS) & (classes <= LOOSE))


def _batches(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of an Arrow batch in groups of about ``size`` tokens: classes, cells, hashes, tokens per text."""
    n = batch.column("n_tokens").to_numpy()
    group = np.cumsum(n) // size
    for at in np.split(np.arange(len(n)), np.flatnonzero(np.diff(group)) + 1):
        if len(at):
            part = batch.slice(at[0], len(at))
            sizes = n[at]
            classes = [_unpacked(r, np.uint8, k) for r, k in zip(part.column("classes").to_pylist(), sizes)]
            cells = [_unpacked(r, np.uint8, k) for r, k in zip(part.column("cells").to_pylist(), sizes)]
            hashes = [_unpacked(r, np.uint16, k) for r, k in zip(part.column("hashes").to_pylist(), sizes)]
            yield np.concatenate(classes), np.concatenate(cells), np.concatenate(hashes), sizes


DELTA = "rows int, salt int, change binary, tasks binary"  # chunks of ROWS_EACH rows, those of cells after those of classes
MINI = 8192


def _summed(deltas: DataFrame, *keys: str) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        change = np.sum([np.frombuffer(b, np.float32) for b in table["change"].to_pylist()], axis=0, dtype=np.float32)
        tasks = np.sum([np.frombuffer(b, np.int32) for b in table["tasks"].to_pylist()], axis=0, dtype=np.int32)
        return pa.table({"rows": table["rows"][:1], "salt": table["salt"][:1], "change": [change.tobytes()], "tasks": [tasks.tobytes()]})

    return deltas.groupBy(*keys).applyInArrow(run, DELTA)


class Model(NamedTuple):
    """Weights and biases of the classes, and of the cells of each class."""

    weights: np.ndarray
    bias: np.ndarray
    cell_weights: np.ndarray
    cell_bias: np.ndarray


def _untrained(totals: Totals) -> Model:
    bias = np.log((totals.class_tokens + 0.5) / (totals.tokens + 0.5 * CLASSES)).astype(np.float32)
    # a cell without tokens has no mass
    cells = np.log(np.maximum(totals.cell_tokens, 1e-18) / np.maximum(totals.class_tokens, 1)[:, None]).astype(np.float32)
    return Model(np.zeros((TEMPLATES * BUCKETS, CLASSES), np.float32), bias, np.zeros((TEMPLATES * totals.inner_buckets, CELLS), np.float32), cells)


def _changes(new: np.ndarray, old: np.ndarray, squares: np.ndarray, first: int, salt: int) -> Iterator[pa.RecordBatch]:
    changed = (squares > 1.0).astype(np.int32)
    for i in range(0, len(new), ROWS_EACH):
        at = slice(i, i + ROWS_EACH)
        if changed[at].any():
            yield pa.RecordBatch.from_pydict({
                "rows": pa.array([first + i // ROWS_EACH], pa.int32()), "salt": pa.array([salt], pa.int32()),
                "change": [(new[at] - old[at]).tobytes()], "tasks": [changed[at].tobytes()],
            })


def train(texts: DataFrame, totals: Totals, rounds: int = 3, rate: float = 0.3) -> Model:
    """The model from all texts that are not held out."""
    model = _untrained(totals)
    learned = texts.filter(~F.col("held_out")).select("doc_id", "n_tokens", "classes", "cells", "hashes")
    tasks = max(1, -(-totals.tokens // (rounds * TASK_TOKENS * totals.growth)))
    salts = math.isqrt(tasks - 1) + 1  # the first sums and the last one take as many parts each
    chunks = len(model.weights) // ROWS_EACH
    for turn in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], now: Model = model) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own, squares = now.weights.copy(), np.full(len(now.weights), 1.0, np.float32)
            own_cells, cell_squares = now.cell_weights.copy(), np.full(len(now.cell_weights), 1.0, np.float32)
            buckets = len(own_cells) // TEMPLATES
            for batch in batches:
                for classes, cells, hashes, sizes in _batches(batch, 8 * MINI):
                    past = histories(hashes, sizes)
                    rows = hashed(past, BUCKETS)
                    for i in range(0, len(rows), MINI):
                        gradient_steps(own, now.bias, squares, rows[i : i + MINI], classes[i : i + MINI], rate)
                    inner = _grouped(classes)
                    for i in range(0, len(inner), MINI):
                        at = inner[i : i + MINI]
                        k = classes[at]
                        cell_steps(own_cells, now.cell_bias[k], cell_squares, cell_rows(past, at, k, buckets), cells[at], rate)
            salt = TaskContext.get().partitionId() % salts
            yield from _changes(own, now.weights, squares, 0, salt)
            yield from _changes(own_cells, now.cell_weights, cell_squares, chunks, salt)

        share = learned.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == turn).coalesce(tasks)
        deltas = _summed(_summed(share.mapInArrow(run, DELTA), "rows", "salt"), "rows").collect()  # the size of the weights
        weights, cell_weights = model.weights.copy(), model.cell_weights.copy()
        for row in deltas:
            table, first = (weights, row["rows"]) if row["rows"] < chunks else (cell_weights, row["rows"] - chunks)
            at = slice(first * ROWS_EACH, (first + 1) * ROWS_EACH)
            many = np.maximum(np.frombuffer(row["tasks"], np.int32), 1)
            table[at] += np.frombuffer(row["change"], np.float32).reshape(len(many), -1) / many[:, None]
        model = model._replace(weights=weights, cell_weights=cell_weights)
    return model


def token_scores(model: Model, unknown: np.ndarray, classes: np.ndarray, cells: np.ndarray, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """ln P(class, cell | history) of every token; of an unknown one, ln of its own probability."""
    past = histories(hashes, sizes)
    rows = hashed(past, BUCKETS)
    out = np.zeros(len(rows))
    for i in range(0, len(rows), MINI):
        logs, own = log_probabilities(model.weights, model.bias, rows[i : i + MINI]), classes[i : i + MINI]
        known = own != UNKNOWN
        value = logs[np.arange(len(own)), np.where(known, own, 0)]
        if not known.all():
            value[~known] = np.log(np.maximum(np.exp(logs[~known]) @ unknown, 1e-30))
        out[i : i + MINI] = value
    inner = _grouped(classes)
    buckets = len(model.cell_weights) // TEMPLATES
    for i in range(0, len(inner), MINI):
        at = inner[i : i + MINI]
        logs = log_probabilities(model.cell_weights, model.cell_bias[classes[at]], cell_rows(past, at, classes[at], buckets))
        out[at] += logs[np.arange(len(at)), cells[at]]
    return out


def text_scores(texts: DataFrame, totals: Totals, model: Model) -> DataFrame:
    """Appends ``score``: log10 of the model's probability of the whole text."""
    unknown = totals.unknown_share.astype(np.float32)
    scale = 1 / math.log(10)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    empty = not totals.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = batch.column("inside").to_numpy().copy()
            done = 0
            for classes, cells, hashes, sizes in _batches(batch, MINI):
                each = token_scores(model, unknown, classes, cells, hashes, sizes)
                score[done : done + len(sizes)] += np.add.reduceat(each, np.cumsum(sizes) - sizes) * scale
                done += len(sizes)
            if empty:
                score[:] = 0.0
            columns = [batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], [f.split()[0] for f in out.split(", ")])

    return texts.mapInArrow(run, out)


def score_texts(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text", rounds: int = 3) -> DataFrame:
    """Learns from the rows where ``held_out`` is not true and scores all rows."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cut = written(blocks(rows), "blocks")
    entries, totals = with_totals(cut)
    texts = written(encoded(cut, entries, totals), "encoded")
    return text_scores(texts, totals, train(texts, totals, rounds)).withColumn("train_tokens", F.lit(totals.tokens).cast("bigint"))
