"""Preparation of the user-item graph: cores, splits, dense ids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefmine.core import global_position, ratio, stored
from prefmine.sources.schemas import timestamp_of


def core_edges(df: DataFrame, user: str, item: str, k_user: int, k_item: int, max_rounds: int | None = None):
    """Surviving (user, item, n) edges of the k-core and the number of edge rows after each round.

    Rows of the same pair live or die together, so the loop runs on one row per pair with its
    multiplicity. Each round counts users and items on the same snapshot, as the fixpoint is
    defined, and is written to reliable storage before the next one.
    """
    edges = stored(df.groupBy(user, item).agg(F.count(F.lit(1)).alias("n")), "edges")
    size = edges.agg(F.sum("n")).first()[0] or 0
    history = []
    while max_rounds is None or len(history) < max_rounds:
        users = edges.groupBy(user).agg(F.sum("n").alias("c")).filter(F.col("c") >= k_user)
        items = edges.groupBy(item).agg(F.sum("n").alias("c")).filter(F.col("c") >= k_item)
        kept = stored(edges.join(users, user, "left_semi").join(items, item, "left_semi"), "edges")
        left = kept.agg(F.sum("n")).first()[0] or 0
        history.append(left)
        edges = kept
        if left == size:
            break
        size = left
    return edges, history


def k_core(df: DataFrame, user: str, item: str, k: int, k_item: int | None = None, max_rounds: int | None = None) -> DataFrame:
    """Rows whose user and item both keep at least ``k`` rows, repeated until nothing is removed."""
    edges, _ = core_edges(df, user, item, k, k if k_item is None else k_item, max_rounds)
    return df.join(edges.select(user, item), [user, item], "left_semi")


def min_interactions(df: DataFrame, user: str, item: str, min_user: int = 5, min_item: int = 5) -> DataFrame:
    """Users and items with enough rows, both counted once on the input."""
    users = df.groupBy(user).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= min_user)
    items = df.groupBy(item).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= min_item)
    return df.join(users, user, "left_semi").join(items, item, "left_semi")


def with_final_stage(df: DataFrame, user: str, stage: str, final: int = 3) -> DataFrame:
    """All rows of users who reached the final stage at least once."""
    return df.join(df.filter(F.col(stage) == final).select(user).distinct(), user, "left_semi")


def stage_of(is_read: Column, rating: Column, threshold: int = 4) -> Column:
    """0 shelved, 1 read, 2 rated, 3 rated at least ``threshold``."""
    return (
        F.when(rating >= threshold, 3).when(rating > 0, 2).when(is_read == 1, 1).otherwise(0)
    )


def dense_index(ids: DataFrame, column: str, name: str = "idx") -> DataFrame:
    """Distinct ids with their 0-based position in sorted order, from a distributed sort."""
    distinct = ids.select(column).filter(F.col(column).isNotNull()).distinct()
    return global_position(distinct, [F.col(column)], "__pos").select(column, (F.col("__pos") - 1).alias(name))


def encode(df: DataFrame, column: str, index: DataFrame, name: str) -> DataFrame:
    return df.join(index.select(column, F.col("idx").alias(name)), column)


def temporal_split(df: DataFrame, share: float, order: list[str], out: str = "split") -> DataFrame:
    """Labels the first ``floor(share * n)`` rows of a total order ``train`` and the rest ``test``.

    ``order`` starts with the timestamp and must be unique per row. Day counts find the day the
    cut falls into; only that day is sorted, by a distributed sort. The cut is then one tuple of
    values, and every row is labelled by comparison, without a join or a window over all rows.
    The driver holds one number per day.
    Rows without a timestamp come last.
    """
    day = F.coalesce(F.to_date(order[0]), F.lit("9999-12-31").cast("date"))
    per_day = df.groupBy(day.alias("__day")).agg(F.count(F.lit(1)).alias("__n")).orderBy("__day").collect()
    cut = math.floor(share * sum(row["__n"] for row in per_day))
    seen, cut_day = 0, None
    for row in per_day:
        if seen + row["__n"] > cut:
            cut_day = row["__day"]
            break
        seen += row["__n"]
    if cut_day is None:
        return df.withColumn(out, F.lit("train"))
    late = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    first = timestamp_of(df, order[0]) if isinstance(df.schema[order[0]].dataType, T.TimestampType) else F.col(order[0]).cast("timestamp_ntz")
    columns = [F.coalesce(first, late), *[F.col(c) for c in order[1:]]]
    boundary = df.filter(day == F.lit(cut_day)).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    names = [f"c{i}" for i in range(len(columns))]
    placed = global_position(boundary, [F.col(c) for c in names], "__pos")
    first_test = placed.filter(F.col("__pos") == cut - seen + 1).select(F.struct(*names)).scalar()
    is_train = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)]) < first_test
    return df.withColumn(out, F.when(is_train, "train").otherwise("test"))


def validation_index(val: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Validation rows with a stable 0-based row id in the total order."""
    placed = global_position(val, [F.col(c) for c in order], "__pos")
    return placed.select((F.col("__pos") - 1).alias("oof_row_id"), *columns)


def split_diagnostics(df: DataFrame, subset: str) -> DataFrame:
    """Size and share of every warm or cold subset."""
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = df.groupBy(subset).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", ratio(F.col("n"), total))
