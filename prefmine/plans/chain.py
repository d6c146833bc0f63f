"""Ranking along the chain shelve, read, rate, recommend."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmine.core import cut_lineage, stored
from prefmine.models.factors import Factors, fit_als
from prefmine.operators.graph import dense_index, encode, min_interactions, with_final_stage
from prefmine.operators.windows import suffix_sums


def stage_table(df: DataFrame, user: str, item: str, stage: str, min_user: int = 5, min_item: int = 5, final: int = 3) -> DataFrame:
    """Frequent users and items, users who reached the final stage, dense ids: (u, i, stage)."""
    kept = cut_lineage(with_final_stage(min_interactions(df.select(user, item, stage), user, item, min_user, min_item), user, stage, final))
    coded = encode(encode(kept, user, dense_index(kept, user), "u"), item, dense_index(kept, item), "i")
    return coded.select("u", "i", stage)


def seen_items(df: DataFrame, user: str, item: str) -> DataFrame:
    """Distinct (user, item) pairs. The table stands for the user's item set; it is used by anti-joins."""
    return df.select(user, item).distinct()


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def stage_scores(
    pairs: DataFrame, users: DataFrame, items: DataFrame, stages: list[list[float]], user: str, item: str, offset: float = 0.0, beta: float = 1.0
) -> DataFrame:
    """Adds ``deltas`` and ``scores`` per stage: bias plus the rectified intentions of this and later stages.

    ``users(user, vec, bias)`` and ``items(item, vec, bias)`` are factor tables; ``stages`` is one
    vector per stage, a constant of the plan. Scores never rise from one stage to the next.
    """
    beta = max(beta, 1.0)
    u = users.select(user, F.col("vec").alias("__u"), F.col("bias").alias("__bu"))
    i = items.select(item, F.col("vec").alias("__i"), F.col("bias").alias("__bi"))
    rows = pairs.join(i, item).join(u, user).withColumn("__ui", F.zip_with("__u", "__i", lambda a, b: a * b))

    def delta(vector: list[float]) -> Column:
        weights = F.array(*[F.lit(float(x)) for x in vector])
        intent = F.aggregate(F.zip_with("__ui", weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return softplus(F.lit(beta) * intent) / F.lit(beta)

    rows = rows.withColumn("deltas", F.array(*[delta(v) for v in stages])).withColumn("__b", F.lit(offset) + F.col("__bu") + F.col("__bi"))
    scored = rows.withColumn("scores", F.transform(suffix_sums(F.col("deltas")), lambda x: x + F.col("__b")))
    return scored.drop("__u", "__i", "__ui", "__bu", "__bi", "__b")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def edge_terms(scored: DataFrame, stage: str, n_stages: int = 4) -> DataFrame:
    """Adds the probabilities of the observed stage, of the next one, and of not stopping before it."""
    at = F.col(stage)
    last = at == n_stages - 1
    nxt = F.when(last, 0.0).otherwise(sigmoid(F.get("scores", F.least(at + 1, F.lit(n_stages - 1)))))
    return (
        scored.withColumn("p_stage", sigmoid(F.get("scores", at))).withColumn("p_next", nxt)
        .withColumn("p_cap", F.greatest(1.0 - F.exp(-F.get("deltas", at)), F.lit(1e-8)))
    )


def edge_loss(positives: DataFrame, negatives: DataFrame, stage: str) -> DataFrame:
    """Mean loss terms over scored positives and negatives."""
    floor = F.lit(1e-8)
    pos = edge_terms(positives, stage).agg(F.avg(-F.ln(F.greatest("p_stage", floor))).alias("x")).scalar()
    neg = edge_terms(negatives, stage).agg(
        F.avg(-(F.ln(F.greatest(1.0 - F.col("p_next"), floor)) + F.ln("p_cap"))).alias("loss_neg"), F.count(F.lit(1)).alias("n")
    )
    return neg.select(pos.alias("loss_pos"), "loss_neg", (pos + F.col("loss_neg")).alias("loss"), "n")


def fit_stage_factors(df: DataFrame, user: str, item: str, stage: str, n_stages: int = 4, **params) -> list[Factors]:
    """One implicit factor model per stage, each on the rows that reached it."""
    rows = cut_lineage(df.select(user, item, stage))
    out = []
    for s in range(n_stages):
        cells = stored(rows.filter(F.col(stage) >= s).groupBy(user, item).agg(F.count(F.lit(1)).cast("double").alias("value")), "cells")
        out.append(fit_als(cells, user, item, implicit=True, **params))
    return out


def monotone_scores(pairs: DataFrame, models: list[Factors], key: list[str]) -> DataFrame:
    """Adds ``scores`` per stage: sums of rectified factor scores from each stage to the last."""
    rows = reduce(lambda r, sm: sm[1].score(r, f"__s{sm[0]}"), enumerate(models), pairs)
    parts = [softplus(F.coalesce(f"__s{s}", F.lit(0.0))) for s in range(len(models))]
    return rows.withColumn("scores", suffix_sums(F.array(*parts))).select(*key, "scores")
