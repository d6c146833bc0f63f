"""Sinks. Partitioned writes use the REBALANCE hint: small partitions merge, a hot one splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefmine.functions.scalars import file_slug


def write_partitioned(df: DataFrame, path: str, by: str, mode: str = "overwrite", compression: str = "snappy") -> None:
    """One folder per value of ``by``."""
    df.hint("rebalance", by).write.mode(mode).partitionBy(by).option("compression", compression).parquet(path)


def write_compressed(df: DataFrame, path: str, compression: str = "zstd") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def write_bounded(df: DataFrame, path: str, max_rows: int = 500_000) -> None:
    """Files of at most ``max_rows`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", max_rows).parquet(path)


def write_clean_by_category(df: DataFrame, path: str, category: str, columns: list[str]) -> None:
    """Appends the named columns to one folder per category, named by its slug."""
    rows = df.select(*columns, file_slug(category).alias("slug"))
    write_partitioned(rows, path, "slug", mode="append")


def compact(df: DataFrame, path: str, by: str) -> None:
    """Rewrites many small files per partition as few; reading back restores ``by`` as a column."""
    write_partitioned(df, path, by)


def write_report(df: DataFrame, path: str) -> None:
    """An aggregated table as CSV with header and as JSON records."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    df.coalesce(1).write.mode("overwrite").json(f"{path}/json")


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row run summary as JSON."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path)


def summary(df: DataFrame, split: str, user: str, item: str, rating: str, date: str) -> DataFrame:
    """One row: sizes of both sides, distinct ids, mean rating and the first day of the test side."""
    train, test = F.col(split) == "train", F.col(split) == "test"
    return df.agg(
        F.count_if(train).alias("n_train"), F.count_if(test).alias("n_test"), F.countDistinct(user).alias("n_users"),
        F.countDistinct(item).alias("n_items"), F.avg(F.when(train, F.col(rating))).alias("global_mean"),
        F.min(F.when(test, F.to_date(date))).alias("split_date"),
    )
