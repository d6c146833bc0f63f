"""Matrix products and factorisations of tables (row, column, value).

Tables of vectors are frames (id, vec). Only square matrices of the size of one vector reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from prefmine.core import global_position, hash_uniform, null_safe_join, stored


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column, eps: float = 1e-12) -> Column:
    """Vector divided by its length, the length being at least ``eps``."""
    length = F.greatest(norm(v), F.lit(eps))
    return F.transform(v, lambda x: x.cast("double") / length)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def sum_vectors(df: DataFrame, key: str, vec: str, weight: Column, dims: int) -> DataFrame:
    """Weighted sum of vectors per key, one running sum per dimension, combined before the shuffle."""
    rows = df.select(key, F.col(vec).alias("__v"), weight.cast("double").alias("__w"))
    sums = rows.groupBy(key).agg(*[F.sum(F.col("__v")[i] * F.col("__w")).alias(f"__{i}") for i in range(dims)])
    return sums.select(key, F.array(*[F.col(f"__{i}") for i in range(dims)]).alias(vec))


def gram(df: DataFrame, vec: str) -> np.ndarray:
    """Sum over rows of the outer product of ``vec`` with itself. Each task sends one small matrix."""

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in parts:
            if len(part):
                x = np.stack(part["v"].to_numpy()).astype(float)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            flat = total.ravel()
            yield pd.DataFrame({"at": np.arange(len(flat), dtype="int64"), "x": flat})

    sums = df.select(F.col(vec).cast("array<double>").alias("v")).mapInPandas(partial, "at bigint, x double")
    rows = sums.groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    size = int(round(len(rows) ** 0.5))
    return np.array([r["x"] for r in rows]).reshape(size, size)


CELL_PAIRS = 250_000  # of one task of cell_products, about


def cell_products(
    pairs: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str, vec: str, products: dict[str, tuple[int | None, bool]], expected: int
) -> DataFrame:
    """Inner join of ``pairs`` with both vectors of each pair, of which only products are kept.

    A product is the name of its column, the number of leading elements (None: all) and whether it is divided by both lengths
    (:func:`cosine`, else :func:`dot`). Keys are whole numbers. Pairs and vectors are dealt into cells of a square grid, about ``CELL_PAIRS`` of the
    ``expected`` pairs each: a vector travels once per row or column of the grid, and not once per pair.
    """
    side = max(1, int(np.ceil((expected / CELL_PAIRS) ** 0.5)))
    block = lambda c: F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(side))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(side - 1).cast("bigint")))
    kept = pairs.columns
    payload = [F.lit(None).cast(pairs.schema[c].dataType).alias(f"__p{n}") for n, c in enumerate(kept)]
    parts = []
    for kind, frame, key in ((1, left, left_key), (2, right, right_key)):
        rows = frame.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("__key"), F.col(vec).alias("__vec"), every.alias("__every"))
        at = block("__key") * side + F.col("__every") if kind == 1 else F.col("__every") * side + block("__key")
        parts.append(rows.select(at.alias("__cell"), F.lit(kind).alias("__kind"), "__key", F.lit(None).cast("bigint").alias("__other"), "__vec", *payload))
    known = pairs.filter(F.col(left_key).isNotNull() & F.col(right_key).isNotNull())
    none = F.lit(None).cast(parts[0].schema["__vec"].dataType).alias("__vec")
    parts.append(known.select(
        (block(left_key) * side + block(right_key)).alias("__cell"), F.lit(0).alias("__kind"), F.col(left_key).cast("bigint").alias("__key"),
        F.col(right_key).cast("bigint").alias("__other"), none, *[F.col(c).alias(f"__p{n}") for n, c in enumerate(kept)],
    ))

    def columns(vectors: pa.ChunkedArray) -> np.ndarray:
        """One row per position and one column per vector; what is null or missing is NaN."""
        lists = vectors.combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out = np.full((int(sizes.max(initial=0)), len(sizes)), np.nan)
        out[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.arange(len(sizes)), sizes)] = flat
        return out

    def run(table: pa.Table) -> pa.Table:
        kinds = table["__kind"].to_numpy()
        rows, *sides = [table.filter(pa.array(kinds == k)).combine_chunks() for k in (0, 1, 2)]
        found = pd.DataFrame({"l": rows["__key"].to_numpy(), "r": rows["__other"].to_numpy(), "at": np.arange(len(rows))})
        for name, mine in zip("lr", sides):
            found = found.merge(pd.DataFrame({name: mine["__key"].to_numpy(), f"{name}_at": np.arange(len(mine))}), on=name)
        a, b = (columns(mine["__vec"]) for mine in sides)
        a_at, b_at = found["l_at"].to_numpy(), found["r_at"].to_numpy()

        def total(x: np.ndarray, y: np.ndarray, x_at, y_at, n: int) -> np.ndarray:
            out = np.zeros(len(x_at))
            for j in range(n):  # in the order of the elements, as dot adds them
                out += x[j, x_at] * y[j, y_at]
            return out

        out = {c: rows[f"__p{n}"].take(pa.array(found["at"].to_numpy())) for n, c in enumerate(kept)}
        for name, (n, divided) in products.items():
            dims = max(len(a), len(b)) if n is None else min(n, max(len(a), len(b)))
            if min(len(a), len(b)) < dims:
                value = np.full(len(found), np.nan)
            else:
                value = total(a, b, a_at, b_at, dims)
            if divided and min(len(a), len(b)) >= dims:
                lengths = [np.sqrt(total(x, x, np.arange(x.shape[1]), np.arange(x.shape[1]), dims)) for x in (a, b)]
                by = lengths[0][a_at] * lengths[1][b_at]
                value = np.where(by == 0, np.nan, value / np.where(by == 0, 1.0, by))
            out[name] = pa.array(value, pa.float64(), from_pandas=True)  # NaN becomes null
        return pa.table(out)

    schema = pairs.schema
    for name in products:
        schema = schema.add(name, DoubleType())
    together = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return together.groupBy("__cell").applyInArrow(run, schema)


#: Bytes of vectors and of cells that a task of a product with a sparse table holds, about, and vectors in one packed row.
BLOCK_BYTES, PACKED = 1 << 30, 2048
#: Sparse cells in one packed row.
PACKED_CELLS = 1 << 16
VECTORS = "b int, part int, lo int, vec binary"


class _Grid(NamedTuple):
    """``side`` blocks of rows and of columns, ``slices`` of the elements of a vector, and whether a task reads the ``whole`` of the other side."""

    side: int
    slices: int
    whole: bool

    @classmethod
    def of(cls, cells: int, rows: int, cols: int, dims: int) -> _Grid:
        """The grid that moves least: vectors travel once per block of the other side, cells once per slice, and sums where several tasks make parts of them."""
        sparse, both = cells * 16, (rows * dims * 8, cols * dims * 8)
        fitting = []
        for side in range(3, 1 << 10):  # 3: tasks at work
            for whole in (True, False):
                held, cut = (sparse / side, max(both) + max(both) / side) if whole else (sparse / side**2, sum(both) / side)
                slices = max(1, int(np.ceil(cut / (BLOCK_BYTES - held)))) if held < BLOCK_BYTES else dims + 1
                if slices <= dims:
                    added = (slices > 1) * sum(both) if whole else side * sum(both)
                    fitting.append((side * sum(both) + 2 * slices * sparse + added, cls(side, slices, whole)))
        return min(fitting)[1]

    def cuts(self, dims: int) -> list[slice]:
        stops = np.linspace(0, dims, min(self.slices, dims) + 1).astype(int).tolist()
        return [slice(a, b) for a, b in zip(stops, stops[1:])]


def _indexed(entries: DataFrame, column: str, out: str) -> DataFrame:
    """(id, position from 0) of distinct ids, a null one too."""
    placed = global_position(entries.select(column).distinct(), [F.col(column)], "__pos")
    return stored(placed.select(column, (F.col("__pos") - 1).alias(out)), "svd-index")


def _size(index: DataFrame, column: str, out: str) -> tuple[int, int | None]:
    """Number of ids, and the position of the null one."""
    found = index.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col(column).isNull(), F.col(out))).alias("at")).first()
    return found["n"], found["at"]


def _packed_cells(coded: DataFrame, side: int) -> DataFrame:
    """(r, c: blocks; i, j: places in them; x) with the cells of a task in rows of about ``PACKED_CELLS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[np.ndarray, ...]]] = {}
        sizes = dict.fromkeys(range(side * side), 0)

        def packed(cell: int) -> pa.RecordBatch:
            i, j, x = (np.concatenate(part) for part in zip(*kept.pop(cell)))
            sizes[cell] = 0
            return pa.RecordBatch.from_pydict({
                "r": pa.array([cell // side], pa.int32()), "c": pa.array([cell % side], pa.int32()),
                "i": [i.tobytes()], "j": [j.tobytes()], "x": [x.tobytes()],
            })

        for batch in batches:
            r, c, x = (batch.column(n).to_numpy() for n in ("__r", "__c", "__x"))
            cell = r % side * side + c % side
            order = np.argsort(cell, kind="stable")
            edges = np.searchsorted(cell[order], np.arange(side * side + 1))
            for at in np.flatnonzero(np.diff(edges)).tolist():
                rows = order[edges[at] : edges[at + 1]]
                kept.setdefault(at, []).append(((r[rows] // side).astype(np.int32), (c[rows] // side).astype(np.int32), x[rows]))
                sizes[at] += len(rows)
                if sizes[at] >= PACKED_CELLS:
                    yield packed(at)
        for at in list(kept):
            yield packed(at)

    return coded.mapInArrow(run, "r int, c int, i binary, j binary, x binary")


def _packed_rows(b: int, part: int, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(matrix), PACKED):
        yield pa.RecordBatch.from_pydict({
            "b": pa.array([b], pa.int32()), "part": pa.array([part], pa.int32()), "lo": pa.array([lo], pa.int32()), "vec": [matrix[lo : lo + PACKED].tobytes()],
        })


def _unpacked(value: pa.BinaryScalar, dims: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.float64).reshape(-1, dims)


def _packed_vectors(vectors: DataFrame, at: str, side: int, dims: int, n: int) -> DataFrame:
    """Packed vectors of (at, vec), whose positions are dealt in turn to ``side`` blocks."""

    def run(table: pa.Table) -> pa.Table:
        at_, flat = table["__at"].to_numpy(), table["vec"].combine_chunks().flatten().to_numpy()
        b, place = int(at_[0]) % side, at_ // side
        lo = int(place[0]) // PACKED * PACKED
        matrix = np.zeros((min(PACKED, -(-(n - b) // side) - lo), dims))
        matrix[place - lo] = flat.reshape(-1, dims)
        return pa.table({"b": pa.array([b], pa.int32()), "part": pa.array([0], pa.int32()), "lo": pa.array([lo], pa.int32()), "vec": [matrix.tobytes()]})

    rows = vectors.select(F.col(at).alias("__at"), "vec", F.pmod(at, F.lit(side)).alias("__b"), F.floor(F.col(at) / side / PACKED).alias("__chunk"))
    return rows.groupBy("__b", "__chunk").applyInArrow(run, VECTORS)


def _unpacked_vectors(packed: DataFrame, matrix: np.ndarray, side: int, index: DataFrame, column: str, at: str) -> DataFrame:
    """(id, vec) of packed vectors, each multiplied by a small matrix from the right."""
    dims = len(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, lo, vec in zip(*(batch.column(c) for c in ("b", "lo", "vec"))):
                out = _unpacked(vec, dims) @ matrix
                offsets = np.arange(0, out.size + 1, out.shape[1] or 1, dtype=np.int32)
                yield pa.RecordBatch.from_pydict({
                    at: pa.array((np.arange(len(out)) + lo.as_py()) * side + b.as_py(), pa.int64()), "vec": pa.ListArray.from_arrays(offsets, out.ravel()),
                })

    return packed.mapInArrow(run, f"{at} bigint, vec array<double>").join(index, at).select(column, "vec")


def _packed_gram(packed: DataFrame, dims: int) -> np.ndarray:
    """:func:`gram` of packed vectors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            for vec in batch.column("vec"):
                x = _unpacked(vec, dims)
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(dims * dims), pa.int64()), "x": total.ravel()})

    rows = packed.select("vec").mapInArrow(partial, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    return np.array([r["x"] for r in rows] or np.zeros(dims * dims)).reshape(dims, dims)


def _packed_product(cells: DataFrame, vectors: DataFrame, matrix: np.ndarray | None, grid: _Grid, dims: int, forward: bool, sizes: tuple[int, int], null: int | None) -> DataFrame:
    """Packed A V of packed V, or A' V unless ``forward``, V being multiplied by ``matrix`` first; stored.

    ``sizes`` are the numbers of vectors read and made. The vector at ``null`` counts as nothing. A task makes one slice of the elements of one block,
    from one block that it reads, whose sums are then added up, or from all of them. So a vector is shuffled ``side`` times, whatever the number of its cells.
    """
    side, cuts = grid.side, grid.cuts(dims)
    n_read, n_made = sizes

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, lo, vec in zip(*(batch.column(c) for c in ("b", "lo", "vec"))):
                whole = _unpacked(vec, dims)
                whole = whole.copy() if matrix is None else whole @ matrix
                if null is not None and null % side == b.as_py() and 0 <= null // side - lo.as_py() < len(whole):
                    whole[null // side - lo.as_py()] = 0.0
                yield pa.RecordBatch.from_pydict({
                    "b": pa.array([b.as_py()] * len(cuts), pa.int32()), "part": pa.array(range(len(cuts)), pa.int32()), "lo": pa.array([lo.as_py()] * len(cuts), pa.int32()),
                    "vec": [whole[:, cut].tobytes() for cut in cuts],
                })

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, found, key = {}, [], None
        for batch in batches:
            for to, of, part, lo, vec, i, j, x in zip(*(batch.column(c) for c in ("to", "of", "part", "lo", "vec", "i", "j", "x"))):
                key, of = (to.as_py(), part.as_py()), of.as_py()
                width = cuts[key[1]].stop - cuts[key[1]].start
                if vec.is_valid:
                    if of not in read:
                        read[of] = np.zeros((-(-(n_read - of) // side), width))
                    some = _unpacked(vec, width)
                    read[of][lo.as_py() : lo.as_py() + len(some)] = some
                else:
                    found.append((of, *(np.frombuffer(v.as_buffer(), t).copy() for v, t in ((i, np.int32), (j, np.int32), (x, np.float64)))))
        made = np.zeros((-(-(n_made - key[0]) // side), width))
        for of, i, j, x in found:
            order = np.argsort(i, kind="stable")
            for at in range(0, len(order), 1 << 13):
                rows = order[at : at + (1 << 13)]
                to = i[rows]
                starts = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                made[to[starts]] += np.add.reduceat(read[of][j[rows]] * x[rows, None], starts, axis=0)
        yield from _packed_rows(*key, made)

    def added(table: pa.Table) -> pa.Table:
        parts = table["part"].to_pylist()
        sums = [sum(_unpacked(vec, cut.stop - cut.start) for vec, p in zip(table["vec"], parts) if p == k) for k, cut in enumerate(cuts)]
        whole = np.ascontiguousarray(np.concatenate(sums, axis=1))
        return pa.table({"b": table["b"][:1], "part": pa.array([0], pa.int32()), "lo": table["lo"][:1], "vec": [whole.tobytes()]})

    made_by, read_by, i, j = ("r", "c", "i", "j") if forward else ("c", "r", "j", "i")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    nothing = F.lit(None).cast("binary")
    shipped = vectors.mapInArrow(sliced, VECTORS).select(
        every(side).alias("to"), F.col("b").alias("of"), "part", "lo", "vec", *[nothing.alias(c) for c in ("i", "j", "x")]
    )
    met = cells.select(
        F.col(made_by).alias("to"), F.col(read_by).alias("of"), every(len(cuts)).alias("part"), F.lit(0).alias("lo"), nothing.alias("vec"),
        F.col(i).alias("i"), F.col(j).alias("j"), "x",
    )
    partial = shipped.unionByName(met).groupBy("to", "part", *([] if grid.whole else ["of"])).applyInArrow(multiplied, VECTORS)
    once = grid.whole and len(cuts) == 1
    return stored(partial if once else partial.groupBy("b", "lo").applyInArrow(added, VECTORS), "svd-vectors")


class Svd(NamedTuple):
    """Rows (row, vec) = U S, columns (col, vec) = V, singular values, the share of the sum of squares they explain, and of the
    leading pairs the length of A v - s u after the rounds, as shares of the largest singular value."""

    rows: DataFrame
    cols: DataFrame
    singular: np.ndarray
    share: float
    residuals: np.ndarray


def truncated_svd(entries: DataFrame, row: str, col: str, value: str, k: int, rounds: int = 4, extra: int = 4, seed: int = 42, tol: float = 0.0) -> Svd:
    """Leading ``k`` singular triples of a sparse table by block power iteration.

    The dense blocks have one vector per row or column id; ids are coded as positions once. Each half step is a product in cells of a grid of
    row and column blocks (:func:`_packed_product`), and only
    (k + extra) x (k + extra) matrices are solved on the driver. ``rounds`` is the largest number of rounds: they stop
    once the residuals of all ``k`` pairs are at most ``tol``. Residuals cost nothing, as v and s come from A' u, which
    makes |A v - s u|^2 = |A v|^2 - s^2; squares leave them about eight digits.
    """
    dims = k + extra
    entries = entries.select(row, col, F.col(value).cast("double").alias("__x"))
    rows, cols = _indexed(entries, row, "__r"), _indexed(entries, col, "__c")
    (n_rows, null_row), (n_cols, null_col) = _size(rows, row, "__r"), _size(cols, col, "__c")
    known = entries.filter(F.col("__x").isNotNull())
    coded = null_safe_join(null_safe_join(known, rows, [row], "inner"), cols, [col], "inner").select("__r", "__c", "__x")
    grid = _Grid.of(entries.count(), n_rows, n_cols, dims)
    cells = stored(_packed_cells(coded, grid.side), "svd-cells")
    start = cols.select("__c", F.array(*[(hash_uniform(seed + i, col) - 0.5) for i in range(dims)]).alias("vec"))
    block = stored(_packed_vectors(start, "__c", grid.side, dims, n_cols), "svd-vectors")
    turn = np.eye(dims)

    def orthonormal(square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The matrix that makes vectors with these products orthonormal, and their squared lengths."""
        values, vectors = np.linalg.eigh(square)
        scale = np.where(values > values.max() * 1e-12, 1.0 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
        return vectors * scale, values

    def lacking(square: np.ndarray, values: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(np.diag(square) - np.maximum(values, 0.0), 0.0))
        return rest[np.argsort(-values)[:k]] / max(np.sqrt(max(values.max(), 0.0)), 1e-300)

    values = None
    for at in range(rounds + 1):
        scores = _packed_product(cells, block, turn, grid, dims, True, (n_cols, n_rows), null_col)
        square = _packed_gram(scores, dims)
        residuals = np.full(k, np.inf) if values is None else lacking(square, values)
        if at == rounds or residuals.max(initial=0.0) <= tol:
            break
        block = _packed_product(cells, scores, orthonormal(square)[0], grid, dims, False, (n_rows, n_cols), null_row)
        turn, values = orthonormal(_packed_gram(block, dims))
    values, vectors = np.linalg.eigh(square)
    lead = np.argsort(-values)[:k]
    rotation, singular = vectors[:, lead], np.sqrt(np.maximum(values[lead], 0.0))
    total = entries.agg(F.sum(F.col("__x") * F.col("__x"))).first()[0] or 1.0
    return Svd(
        _unpacked_vectors(scores, rotation, grid.side, rows, row, "__r"), _unpacked_vectors(block, turn @ rotation, grid.side, cols, col, "__c"),
        singular, float((singular**2).sum() / total), residuals,
    )


def positive_ridge(xtx: np.ndarray, xty: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge coefficients that may not be negative, exactly, by trying every set of active columns."""
    n = len(xty)
    best, best_value = np.zeros(n), 0.0
    for mask in range(1, 1 << n):
        on = [i for i in range(n) if mask >> i & 1]
        a = xtx[np.ix_(on, on)] + alpha * np.eye(len(on))
        w = np.linalg.solve(a, xty[on])
        if (w < 0).any():
            continue
        value = float(w @ a @ w - 2 * w @ xty[on])
        if value < best_value:
            best_value, best = value, np.zeros(n)
            best[on] = w
    return best
