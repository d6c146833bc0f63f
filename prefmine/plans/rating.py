"""Rating prediction from a raw log: core, split, shrunk means, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame

from prefmine.core import stored
from prefmine.evaluation.ratings import subset_scores
from prefmine.models.means import mean_baseline
from prefmine.operators.graph import k_core, temporal_split
from prefmine.operators.joins import warm_or_cold


def core_split(df: DataFrame, user: str, item: str, order: list[str], k: int = 5, share: float = 0.8) -> DataFrame:
    """k-core labelled train and test by time. The input and its core are written once, column by column; every later step reads them."""
    core = stored(k_core(stored(df, "log"), user, item, k), "core")
    return temporal_split(core, share, order)


def sides(split: DataFrame, user: str, item: str) -> tuple[DataFrame, DataFrame]:
    """Training rows and test rows with their warm or cold subset."""
    train = split.filter("split = 'train'")
    return train, warm_or_cold(split.filter("split = 'test'"), train, user, item)


def baseline_report(df: DataFrame, user: str, item: str, rating: str, order: list[str], k: int = 5, share: float = 0.8) -> DataFrame:
    df = df.select(*dict.fromkeys([user, item, rating, *order]))
    train, test = sides(core_split(df, user, item, order, k, share), user, item)
    return subset_scores(mean_baseline(train, test, user, item, rating), "subset", rating, "pred")
