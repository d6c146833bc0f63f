"""Fitted models as folders: one Parquet table per part and a description, which is written last.

A folder without a description is an unfinished save and can't be loaded. What is loaded predicts without training rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefmine.models.factors import Factors, SvdModel, score_pairs
from prefmine.models.means import overall, predict_means, raw_means, shrunk


def save(spark: SparkSession, path: str, kind: str, tables: dict[str, DataFrame], values: dict) -> None:
    """Writes the parts of a model; the folder must be new. ``values`` are numbers and names."""
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
    text = json.dumps({"kind": kind, "tables": sorted(tables), "values": values}, sort_keys=True)
    spark.createDataFrame([(text,)], "description string").coalesce(1).write.parquet(f"{path}/description")


def load(spark: SparkSession, path: str, kind: str) -> tuple[dict[str, DataFrame], dict]:
    """Tables and values of a saved model of this kind."""
    found = json.loads(spark.read.parquet(f"{path}/description").first()["description"])
    if found["kind"] != kind:
        raise ValueError(f"{path} holds a model of kind {found['kind']}, not {kind}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in found["tables"]}, found["values"]


class MeansModel:
    """User and item means and what stands for an unknown side."""

    def __init__(self, users: DataFrame, items: DataFrame, default: float | None, user: str, item: str):
        self.users, self.items, self.default, self.user, self.item = users, items, default, user, item

    def predict(self, rows: DataFrame, out: str = "pred") -> DataFrame:
        return predict_means(rows, self.users, self.items, F.lit(self.default).cast("double"), self.user, self.item, out)

    def save(self, spark: SparkSession, path: str) -> None:
        values = {"default": self.default, "user": self.user, "item": self.item}
        save(spark, path, "means", {"users": self.users, "items": self.items}, values)


def fit_means(train: DataFrame, user: str, item: str, rating: str, shrink: bool = True) -> MeansModel:
    users, items = raw_means(train, user, rating), raw_means(train, item, rating)
    default = users.select(overall(users)).first()
    if shrink:
        users, items = shrunk(users), shrunk(items)
    return MeansModel(users.select(user, "mean"), items.select(item, "mean"), default[0] if default else None, user, item)


def load_means(spark: SparkSession, path: str) -> MeansModel:
    tables, values = load(spark, path, "means")
    return MeansModel(tables["users"], tables["items"], values["default"], values["user"], values["item"])


def save_svd(spark: SparkSession, model: SvdModel, path: str) -> None:
    default = model.means.agg(F.first(model.default)).first()[0]
    values = {"default": default, "user": model.user, "item": model.item, "share": model.share}
    save(spark, path, "svd", {"users": model.users, "items": model.items, "means": model.means}, values)


def load_svd(spark: SparkSession, path: str) -> SvdModel:
    tables, v = load(spark, path, "svd")
    return SvdModel(tables["users"], tables["items"], tables["means"], F.lit(v["default"]).cast("double"), v["user"], v["item"], v["share"])


class SavedFactors:
    """The vectors of a factor model, which are all that scoring needs."""

    def __init__(self, users: DataFrame, items: DataFrame, user: str, item: str):
        self.users, self.items, self.user, self.item = users, items, user, item

    def score(self, rows: DataFrame, out: str = "score") -> DataFrame:
        """Adds the product of the two vectors, null for unknown users or items."""
        return score_pairs(rows, self.users, self.items, self.user, self.item, out)


def save_factors(spark: SparkSession, model: Factors, path: str) -> None:
    save(spark, path, "factors", {"users": model.user_vectors(), "items": model.item_vectors()}, {"user": model.user, "item": model.item})


def load_factors(spark: SparkSession, path: str) -> SavedFactors:
    tables, values = load(spark, path, "factors")
    return SavedFactors(tables["users"], tables["items"], values["user"], values["item"])
