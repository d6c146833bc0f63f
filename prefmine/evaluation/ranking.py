"""Ranking metrics and the sampled ranking protocol."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefmine.core import ratio


def ideal_gain(n: Column, k: int) -> Column:
    """Gain of ``min(n, k)`` hits at the top of the list."""
    sums, total = [], 0.0
    for i in range(1, k + 1):
        total += 1.0 / math.log2(i + 1)
        sums.append(F.lit(total))
    return F.get(F.array(*sums), F.least(n, F.lit(k)).cast("int") - 1)


def user_metrics(scored: DataFrame, user: str, item: str, score: str, positive: str, ks: tuple[int, ...] = (10, 20), keys: list[str] | None = None) -> DataFrame:
    """Recall@k and NDCG@k per user: hits over min(relevant, k), and binary gain over the ideal gain.

    Ties: positives first, then smaller ids. Ranks and sums follow from one shuffle by user, whose candidates are never more
    than the catalogue.
    """
    keys = keys or []
    is_hit = F.col(positive) == 1
    w = Window.partitionBy(*keys, user).orderBy(F.desc(score), F.desc(positive), F.asc(item))
    ranked = scored.select(*keys, user, item, score, positive).withColumn("rank", F.row_number().over(w))
    aggs = [F.sum(F.when(is_hit, 1).otherwise(0)).alias("n_relevant")]
    for k in ks:
        inside = is_hit & (F.col("rank") <= k) & F.col(user).isNotNull()
        aggs += [F.count_if(inside).alias(f"__h{k}"), F.sum(F.when(inside, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"__g{k}")]
    rows = ranked.groupBy(*keys, user).agg(*aggs).filter("n_relevant > 0")
    out = rows.select(*keys, user, "n_relevant", *[c for k in ks for c in (
        (F.coalesce(f"__h{k}", F.lit(0)) / F.least("n_relevant", F.lit(k))).alias(f"recall_{k}"),
        (F.coalesce(f"__g{k}", F.lit(0.0)) / ideal_gain(F.col("n_relevant"), k)).alias(f"ndcg_{k}"),
    )])
    return out


def mean_metrics(per_user: DataFrame, keys: list[str] | None = None, ks: tuple[int, ...] = (10, 20)) -> DataFrame:
    names = [f"{m}_{k}" for k in ks for m in ("recall", "ndcg")]
    return per_user.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("users"), *[F.avg(n).alias(n) for n in names])


def pairwise_auc(scored: DataFrame, user: str, score: str, positive: str, keys: list[str] | None = None) -> DataFrame:
    """Per user, the share of negatives scored strictly below the user's one positive."""
    keys = [*(keys or []), user]
    pos = scored.filter(F.col(positive) == 1).select(*keys, F.col(score).alias("__p"))
    neg = scored.filter(F.col(positive) == 0).select(*keys, F.col(score).alias("__n"))
    return neg.join(pos, keys).groupBy(*keys).agg(F.avg((F.col("__p") > F.col("__n")).cast("double")).alias("auc"))


def candidates(positives: DataFrame, negatives: DataFrame, user: str, item: str, drawn: bool = False) -> DataFrame:
    """Positives and negatives of each user in one frame with ``positive`` 1 or 0.

    ``drawn`` says that the negatives were drawn for the users of these positives, so they need not be looked up again.
    """
    pos = positives.select(user, item).distinct().withColumn("positive", F.lit(1))
    if not drawn:
        negatives = negatives.join(pos.select(user).distinct(), user, "left_semi")
    return pos.unionByName(negatives.filter(F.col(user).isNotNull()).select(user, item).withColumn("positive", F.lit(0)))


def blend_scores(df: DataFrame, user: str, als: str, taste: str, alphas: list[float]) -> DataFrame:
    """One row per candidate and alpha: alpha * als / max(als) + (1 - alpha) * taste.

    A missing taste score is the mean of the user's other ones, or 0. With alpha 1, or for users
    without taste, the score is the plain factor score. Per-user numbers come
    from one shuffle by user, which also serves the ranks.
    """
    own = Window.partitionBy(user)
    rows = df.filter(F.col(user).isNotNull()).withColumn("__max", F.max(als).over(own)).withColumn("__mean", F.avg(taste).over(own))
    filled = F.coalesce(F.col(taste), F.col("__mean"), F.lit(0.0))
    grid = rows.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    mixed = F.col("alpha") * F.col(als) / (F.col("__max") + 1e-9) + (1 - F.col("alpha")) * filled
    return grid.withColumn("final", F.when((F.col("alpha") >= 1.0) | F.col("__mean").isNull(), F.col(als)).otherwise(mixed)).drop("__max", "__mean")


def best_alpha(metrics: DataFrame) -> DataFrame:
    """The alpha with the highest Recall@10; the first tried, the largest, wins a tie."""
    return metrics.orderBy(F.desc("recall_10"), F.desc("alpha")).limit(1)


def top_items_for_user(items: DataFrame, user_row: DataFrame, item: str, alpha: float = 0.7, k: int = 10) -> DataFrame:
    """Best items of one user over the whole catalogue: min-max scaled factor score plus taste cosine.

    ``items(item, als, taste)`` and the one-row ``user_row(als, taste)`` hold vectors; the user's
    two vectors are constants of the plan, and the catalogue is read in parallel.
    """
    from prefmine.models.linalg import cosine, dot

    row = user_row.select("als", "taste").first()
    u_als, u_taste = (F.array(*[F.lit(float(x)) for x in v]) for v in row)
    scored = items.select(item, dot(F.col("als"), u_als).alias("als_score"), F.coalesce(cosine(F.col("taste"), u_taste), F.lit(0.0)).alias("taste_score"))
    span = scored.agg(F.min("als_score").alias("lo"), F.max("als_score").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    scaled = F.coalesce(ratio(F.col("als_score") - lo, hi - lo), F.lit(0.0))
    return scored.withColumn("score", F.lit(alpha) * scaled + F.lit(1 - alpha) * F.col("taste_score")).orderBy(F.desc("score"), item).limit(k)


def stage_report(scored: DataFrame, test: DataFrame, user: str, item: str, stage: str, score: str, positive: str, k: int) -> DataFrame:
    """Mean AUC, Recall@k and NDCG@k for each stage that has held-out rows (one per user)."""
    per_user = user_metrics(scored, user, item, score, positive, (k,)).join(pairwise_auc(scored, user, score, positive), user)
    rows = test.select(user, stage).distinct().join(per_user, user)
    return rows.groupBy(stage).agg(
        F.count(F.lit(1)).alias("users"), F.avg("auc").alias("auc"), F.avg(f"recall_{k}").alias(f"recall_{k}"), F.avg(f"ndcg_{k}").alias(f"ndcg_{k}")
    )
