"""J8, K6 to K11, L5 and L6: ranking."""

from pyspark.sql import functions as F

from prefmine.core import cut_lineage, rnd, stored
from prefmine.datasets import interactions, table
from prefmine.evaluation import ranking as R
from prefmine.functions import scalars as S
from prefmine.models import factors as Z
from prefmine.models.linalg import cell_products
from prefmine.operators import sampling as G
from prefmine.operators.graph import dense_index
from prefmine.queries.profiles import rounded
from prefmine.queries.registry import query
from prefmine.queries.sampling import negatives_sql

NEG, SEED = 100, 9

# Users and items with embedding vectors; ratings of 4 and more from 2000 on are the positives of the test side.
SIDES = """, it AS (SELECT * FROM interactions WHERE item_id IN (SELECT vec_id FROM embeddings)), tr AS (SELECT * FROM it WHERE year(ts) < 2000),
pos AS (SELECT DISTINCT user_id, item_id FROM it WHERE year(ts) >= 2000 AND rating >= 4 AND user_id IN (SELECT user_id FROM tr) AND item_id IN (SELECT item_id FROM tr)),
seen AS (SELECT user_id, item_id FROM tr UNION SELECT user_id, item_id FROM pos)"""
PROTOCOL = SIDES + negatives_sql("tr", f"SELECT DISTINCT user_id, {NEG} AS want FROM pos", "seen", SEED) + """
, cand AS (SELECT user_id, item_id, 1 AS positive FROM pos UNION ALL SELECT user_id, item_id, 0 FROM neg),
sc AS (SELECT c.*, list_dot_product(u.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS als, CASE WHEN c.item_id % 7 = 0 THEN NULL ELSE
  list_dot_product(u.embedding[1:32]::DOUBLE[], i.embedding[1:32]::DOUBLE[]) / (sqrt(list_dot_product(u.embedding[1:32]::DOUBLE[], u.embedding[1:32]::DOUBLE[])) * sqrt(list_dot_product(i.embedding[1:32]::DOUBLE[], i.embedding[1:32]::DOUBLE[]))) END AS taste
  FROM cand c JOIN embeddings u ON u.vec_id = c.user_id % (SELECT count(*) FROM embeddings) JOIN embeddings i ON i.vec_id = c.item_id),
bl AS (SELECT *, max(als) OVER (PARTITION BY user_id) AS mx, avg(taste) OVER (PARTITION BY user_id) AS mt FROM sc),
fin AS (SELECT user_id, item_id, positive, alpha::DOUBLE AS alpha, CASE WHEN alpha >= 1 OR mt IS NULL THEN als ELSE alpha * als / (mx + 1e-9) + (1 - alpha) * COALESCE(taste, mt, 0) END AS f FROM bl, (SELECT unnest([1.0, 0.7, 0.5, 0.3]) AS alpha)),
rk AS (SELECT *, row_number() OVER (PARTITION BY alpha, user_id ORDER BY f DESC, positive DESC, item_id) AS r, sum(positive) OVER (PARTITION BY alpha, user_id) AS np FROM fin),
um AS (SELECT alpha, user_id, np, sum(CASE WHEN positive = 1 AND r <= 10 THEN 1 ELSE 0 END) / least(np, 10) AS recall_10, sum(CASE WHEN positive = 1 AND r <= 20 THEN 1 ELSE 0 END) / least(np, 20) AS recall_20,
  sum(CASE WHEN positive = 1 AND r <= 10 THEN 1 / log2(r + 1) ELSE 0 END) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= np) AS ndcg_10,
  sum(CASE WHEN positive = 1 AND r <= 20 THEN 1 / log2(r + 1) ELSE 0 END) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 21) t(i) WHERE i <= np) AS ndcg_20 FROM rk GROUP BY 1, 2, 3)
"""
UI = ("user_id", "item_id")
METRICS = ["recall_10", "ndcg_10", "recall_20", "ndcg_20"]


def sides(spark, d):
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"))
    rows = interactions(spark, d).select(*UI, "rating", "n_tokens", F.year("ts").alias("year"))
    rows = stored(rows.join(items, "item_id", "left_semi"), "sides")
    train = rows.filter("year < 2000")
    late = rows.filter("year >= 2000 AND rating >= 4").select(*UI).distinct()
    pos = late.join(train.select("user_id"), "user_id", "left_semi").join(train.select("item_id"), "item_id", "left_semi")
    return train.select(*UI, "rating", "n_tokens"), cut_lineage(pos)


def protocol(spark, d):
    """Positives and sampled negatives of each test user, and how many they are at most."""
    train, pos = sides(spark, d)
    seen = train.select(*UI).unionByName(pos)
    negatives = G.sample_negatives(pos, cut_lineage(dense_index(train, "item_id")), seen, *UI, NEG, SEED)
    sizes = pos.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")).first()
    return R.candidates(pos, negatives, *UI, drawn=True), sizes["n"] + NEG * sizes["users"]


def fixed_scores(spark, d):
    """Candidates scored with embedding vectors as factors and their first half as taste."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    cand, expected = protocol(spark, d)
    cand = cand.withColumn("__uid", F.col("user_id") % e.agg(F.count(F.lit(1))).scalar())
    users, items = e.withColumnRenamed("vec_id", "__uid"), e.withColumnRenamed("vec_id", "item_id")
    rows = cell_products(cand, users, items, "__uid", "item_id", "vec", {"als": (None, False), "taste": (32, True)}, expected)
    return rows.select(*UI, "positive", "als", F.when(F.col("item_id") % 7 != 0, F.col("taste")).alias("taste"))


def blended(spark, d, alphas=(1.0, 0.7, 0.5, 0.3)):
    return R.blend_scores(fixed_scores(spark, d), "user_id", "als", "taste", list(alphas))


@query("k06_recall", PROTOCOL + " SELECT user_id, CAST(np AS BIGINT) AS n_relevant, ROUND(recall_10, 6) AS recall_10, ROUND(recall_20, 6) AS recall_20 FROM um WHERE alpha = 1")
def recall(spark, d):
    out = R.user_metrics(fixed_scores(spark, d), *UI, "als", "positive")
    return rounded(out.select("user_id", "n_relevant", "recall_10", "recall_20"), "recall_10", "recall_20")


@query("k07_ndcg", PROTOCOL + " SELECT user_id, ROUND(ndcg_10, 6) AS ndcg_10, ROUND(ndcg_20, 6) AS ndcg_20 FROM um WHERE alpha = 1")
def ndcg(spark, d):
    return rounded(R.user_metrics(fixed_scores(spark, d), *UI, "als", "positive").select("user_id", "ndcg_10", "ndcg_20"), "ndcg_10", "ndcg_20")


@query("k09_sampled_protocol", PROTOCOL + " SELECT count(*) AS users, " + ", ".join(f"ROUND(avg({m}), 6) AS {m}" for m in METRICS) + " FROM um WHERE alpha = 0.7")
def sampled_protocol(spark, d):
    out = R.mean_metrics(R.user_metrics(blended(spark, d, (0.7,)), *UI, "final", "positive"))
    return rounded(out, *METRICS)


@query("k10_alpha_ablation", PROTOCOL + " SELECT alpha, count(*) AS users, " + ", ".join(f"ROUND(avg({m}), 6) AS {m}" for m in METRICS) + " FROM um GROUP BY alpha")
def alpha_ablation(spark, d):
    out = R.mean_metrics(R.user_metrics(blended(spark, d), *UI, "final", "positive", keys=["alpha"]), ["alpha"])
    return rounded(out, *METRICS)


@query("k10_best_alpha", PROTOCOL + " SELECT alpha, ROUND(avg(recall_10), 6) AS recall_10 FROM um GROUP BY alpha ORDER BY avg(um.recall_10) DESC, alpha DESC LIMIT 1")
def choose_alpha(spark, d):
    out = R.mean_metrics(R.user_metrics(blended(spark, d), *UI, "final", "positive", keys=["alpha"]), ["alpha"])
    return rounded(R.best_alpha(out).select("alpha", "recall_10"), "recall_10")


@query("l05_blended_scores", PROTOCOL + " SELECT user_id, item_id, alpha, ROUND(f, 5) + 0.0 AS final FROM fin")
def blended_scores(spark, d):
    return rounded(blended(spark, d).select(*UI, "alpha", "final"), "final", digits=5)


@query("l06_top_items", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS a, embedding[1:32]::DOUBLE[] AS t FROM embeddings), u AS (SELECT * FROM e WHERE vec_id = 42),
s AS (SELECT e.vec_id AS item_id, list_dot_product(e.a, u.a) AS als, list_dot_product(e.t, u.t) / (sqrt(list_dot_product(e.t, e.t)) * sqrt(list_dot_product(u.t, u.t))) AS taste FROM e, u)
SELECT item_id, ROUND(0.7 * (als - (SELECT min(als) FROM s)) / ((SELECT max(als) FROM s) - (SELECT min(als) FROM s)) + 0.3 * taste, 5) AS score FROM s ORDER BY score DESC, item_id LIMIT 10
""", "")
def top_items(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("als"))
    e = e.withColumn("taste", F.slice("als", 1, 32))
    return R.top_items_for_user(e, e.filter("item_id = 42"), "item_id").select("item_id", rnd("score", 5).alias("score"))


@query("j08_implicit_ranker")
def implicit_ranker(spark, d):
    train, _ = sides(spark, d)
    weights = S.edge_weights("rating", "n_tokens", "n_tokens")["f3_rating_length"]
    cells = stored(train.groupBy(*UI).agg(F.sum(weights).alias("value")), "cells")
    factors = Z.fit_als(cells, *UI, rank=64, iterations=20, reg=0.1, implicit=True, alpha=40.0)
    scored = factors.score(protocol(spark, d)[0], "als")
    return rounded(R.mean_metrics(R.user_metrics(scored, *UI, "als", "positive")), *METRICS, digits=4)
