"""Errors of rating predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmine.core import cut_lineage, exact_quantiles
from prefmine.functions.scalars import clip


def error(actual: str, pred: str) -> Column:
    """Difference to the prediction held within the rating range."""
    return F.col(actual) - clip(pred, 1.0, 5.0)


def score_columns(actual: str, pred: str, suffix: str = "") -> list[Column]:
    e = error(actual, pred)
    return [F.sqrt(F.avg(e * e)).alias(f"rmse{suffix}"), F.avg(F.abs(e)).alias(f"mae{suffix}")]


def scores(df: DataFrame, actual: str, pred: str, keys: list[str] | None = None) -> DataFrame:
    """Rows, RMSE and MAE, overall or per key."""
    return df.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n"), *score_columns(actual, pred))


def subset_scores(df: DataFrame, subset: str, actual: str, pred: str) -> DataFrame:
    """Scores per warm or cold subset and over all rows, from one pass over the predictions."""
    both = df.select(subset, actual, pred).rollup(subset).agg(
        F.grouping(subset).alias("__all"), F.count(F.lit(1)).alias("n"), *score_columns(actual, pred)
    )
    return both.withColumn(subset, F.when(F.col("__all") == 1, "all").otherwise(F.col(subset))).drop("__all")


def star_scores(df: DataFrame, actual: str, preds: dict[str, str]) -> DataFrame:
    """Scores of one or more predictions for each true star."""
    stacked = df.select(
        F.col(actual).alias("star"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(p).cast("double").alias("pred")) for n, p in preds.items()])).alias("p"),
    ).select("star", "p.model", "p.pred")
    return scores(stacked, "star", "pred", ["model", "star"])


def error_distribution(df: DataFrame, actual: str, pred: str, probs: dict[str, float], big: float = 2.0) -> DataFrame:
    """Percentiles of the absolute error and the share of large ones."""
    errors = cut_lineage(df.select(F.abs(error(actual, pred)).alias("e")))
    q = exact_quantiles(errors, "e", probs)
    cut = {name: q.select(name).scalar() for name in probs}
    return errors.agg(
        F.count(F.lit(1)).alias("n"), F.avg("e").alias("mean_error"), *[F.max(c).alias(n) for n, c in cut.items()],
        F.avg((F.col("e") > big).cast("double")).alias("share_big"),
    )


def category_improvement(df: DataFrame, category: str, actual: str, before: str, after: str, labels: DataFrame, min_rows: int = 5) -> DataFrame:
    """RMSE of two predictions per category with enough rows, their difference and the category's label."""
    per = df.groupBy(category).agg(
        F.count(F.lit(1)).alias("n"), score_columns(actual, before, "_before")[0], score_columns(actual, after, "_after")[0]
    ).filter(F.col("n") >= min_rows)
    return per.withColumn("improvement", F.col("rmse_before") - F.col("rmse_after")).join(labels, category)


def improvement_by_label(per: DataFrame, label: str) -> DataFrame:
    """Mean improvement of the categories of each label, each category counting once."""
    return per.groupBy(label).agg(F.count(F.lit(1)).alias("categories"), F.avg("improvement").alias("mean_improvement"))
