"""Reading of the tables, folds, and small helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmine.core import scratch_path


STEP = 1000


def release_memory() -> None:
    """Gives freed memory back: Python workers live on and share an executor's memory with later stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; an unknown id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it back: cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drawn(df: DataFrame, order: Column, n: int) -> DataFrame:
    """At most ``n`` rows, the first by a hash of ``order``, with the hash as ``__order``.

    The bound is first applied to the hash's range with a fifth to spare, so that few rows are sorted.
    """
    rows = df.withColumn("__order", F.xxhash64(order))
    total = rows.count()
    if total > 1.2 * n:
        rows = rows.filter(F.col("__order") < F.lit(int(-(1 << 63) + 1.2 * n / total * (1 << 64))))
    return rows


def with_columns(df: DataFrame, make: Callable[[pa.RecordBatch], dict[str, pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """Appends columns that ``make`` derives from each Arrow batch; a column of the same name is replaced."""
    names = [f.name for f in fields]
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), STEP):  # small steps keep what a step makes small
                batch = whole.slice(at, STEP)
                new = make(batch)
                columns = [batch.column(f.name) for f in kept] + [new[n] for n in names]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + names)
        release_memory()

    return df.mapInArrow(run, schema)


def prefix_sums(values: Column, chunk: int = 256) -> Column:
    """Running totals of an array of ints, in chunks, so that no long array is copied for every element."""
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(chunk)), lambda i: F.slice(values, i + 1, F.lit(chunk)))

    def running(array: Column, first: Column) -> Column:
        start = F.struct(first.alias("sum"), F.array().cast("array<int>").alias("seen"))
        step = lambda acc, v: F.struct((acc["sum"] + v).alias("sum"), F.concat(acc["seen"], F.array(acc["sum"] + v)).alias("seen"))
        return F.aggregate(array, start, step)["seen"]

    total = lambda array: F.aggregate(array, F.lit(0), lambda a, v: a + v)
    ends = running(F.transform(parts, total), F.lit(0))
    begins = F.concat(F.array(F.lit(0)), ends)
    return F.flatten(F.zip_with(parts, F.slice(begins, F.lit(1), F.size(parts)), running))
