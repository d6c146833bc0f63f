"""Mean-based rating prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmine.core import cut_lineage
from prefmine.functions.scalars import clip
from prefmine.operators.joins import lookup


def global_mean(train: DataFrame, rating: str) -> Column:
    return train.agg(F.avg(rating)).scalar()


def raw_means(train: DataFrame, entity: str, rating: str) -> DataFrame:
    """Mean, sum and count per entity. The table is written once; the training rows are read once."""
    stats = cut_lineage(train.groupBy(entity).agg(F.sum(rating).alias("total"), F.count(rating).alias("n")))
    return stats.withColumn("mean", F.try_divide(F.col("total").cast("double"), F.col("n")))


def overall(means: DataFrame) -> Column:
    """Global mean from the table of an entity's means."""
    return means.agg(F.sum("total") / F.sum("n")).scalar()


def shrunk(means: DataFrame) -> DataFrame:
    """Means pulled towards the global mean; the pull is the median number of rows per entity."""
    freq = means.groupBy("n").agg(F.count(F.lit(1)).alias("f"))
    m = freq.agg(F.percentile("n", F.lit(0.5), F.col("f"))).scalar()
    pulled = (F.col("total") + m * overall(means)) / (F.col("n") + m)
    return means.withColumn("raw_mean", F.col("mean")).withColumn("mean", pulled)


def shrunk_means(train: DataFrame, entity: str, rating: str) -> DataFrame:
    return shrunk(raw_means(train, entity, rating))


def predict_means(rows: DataFrame, users: DataFrame, items: DataFrame, default: Column, user: str, item: str, out: str = "pred") -> DataFrame:
    """Average of user and item mean within the rating range; an unknown side counts as ``default``."""
    both = lookup(lookup(rows, users, user, "mean", default, "__um"), items, item, "mean", default, "__im")
    return both.withColumn(out, clip((F.col("__um") + F.col("__im")) / 2.0, 1.0, 5.0)).drop("__um", "__im")


def mean_baseline(train: DataFrame, rows: DataFrame, user: str, item: str, rating: str, shrink: bool = True, out: str = "pred") -> DataFrame:
    users, items = raw_means(train, user, rating), raw_means(train, item, rating)
    default = overall(users)
    if shrink:
        users, items = shrunk(users), shrunk(items)
    return predict_means(rows, users, items, default, user, item, out)
