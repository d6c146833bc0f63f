"""First rows, top rows and set membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefmine.core import top_per_key


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``. Each task keeps one row per key before the shuffle."""
    return top_per_key(df, keys, [F.col(c) for c in order], 1)


def top_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows in a total order (a top-k report)."""
    return df.orderBy(*order).limit(n)


def common_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct ids present in both frames."""
    return left.select(key).intersect(right.select(key))


def missing_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct ids of ``left`` that ``right`` does not have."""
    return left.select(key).subtract(right.select(key))
