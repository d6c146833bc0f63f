"""Ordered computations: ranks, running shares, neighbours in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefmine.core import explode_range
from prefmine.operators.profiles import count_distribution


def long_tail(df: DataFrame, item: str) -> DataFrame:
    """Cumulative share of rows by item rank, most reviewed first, one row per rank.

    Items with equal counts differ only in rank, so the curve follows from the table of counts:
    only that table is ordered, and the ranks are generated from it.
    """
    dist = count_distribution(df, item)
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("n_reviews"))
    everything = Window.partitionBy(F.lit(0))
    n, m = F.col("n_reviews"), F.col("n_entities")
    steps = dist.select(
        "n_reviews", "n_entities", (F.sum(m).over(down) - m).alias("items_before"),
        (F.sum(n * m).over(down) - n * m).alias("rows_before"), F.sum(m).over(everything).alias("total_items"),
        F.sum(n * m).over(everything).alias("total_rows"),
    )
    ranks = explode_range(steps, F.col("n_entities"), "k")
    return ranks.select(
        (F.col("items_before") + F.col("k")).alias("item_rank"), "n_reviews",
        ((F.col("items_before") + F.col("k")) * 100.0 / F.col("total_items")).alias("pct_items"),
        ((F.col("rows_before") + F.col("k") * n) * 100.0 / F.col("total_rows")).alias("pct_reviews"),
    )


def share_at(tail: DataFrame, cuts: list[int]) -> DataFrame:
    """Largest cumulative share within the top ``p`` percent of items, for each ``p``."""
    wide = tail.agg(*[F.max(F.when(F.col("pct_items") <= p, F.col("pct_reviews"))).alias(f"top_{p}") for p in cuts])
    entries = ", ".join(f"{p}, top_{p}" for p in cuts)
    return wide.select(F.expr(f"stack({len(cuts)}, {entries}) AS (top_pct, pct_reviews)"))


def running_sums(df: DataFrame, order: str, value: str) -> DataFrame:
    """Running total up to each row and from each row on, over a small ordered table."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    return df.select(
        order, value, F.sum(value).over(w).alias("running"),
        F.sum(value).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("remaining"),
    )


def suffix_sums(values: Column) -> Column:
    """For each position of an array, the sum from there to the end."""
    positions = F.sequence(F.lit(1), F.size(values))
    return F.transform(
        positions, lambda i: F.aggregate(F.slice(values, i, F.size(values)), F.lit(0.0), lambda a, x: a + x)
    )
