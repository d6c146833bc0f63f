"""O, K8 and K11: chain ranking."""

from pyspark.sql import functions as F

from prefmine.core import cut_lineage, rnd
from prefmine.datasets import stages, table
from prefmine.evaluation import ranking as R
from prefmine.operators import sampling as G
from prefmine.operators.graph import dense_index
from prefmine.plans import chain as C
from prefmine.queries.profiles import rounded
from prefmine.queries.registry import query
from prefmine.queries.sampling import HOLDOUT, negatives_sql

UI = ("user_id", "item_id")
NEG = 20


@query("o01_stage_table", """
, m AS (SELECT user_id, item_id, stage FROM stages WHERE user_id IN (SELECT user_id FROM stages GROUP BY 1 HAVING count(*) >= 45) AND item_id IN (SELECT item_id FROM stages GROUP BY 1 HAVING count(*) >= 75)),
f AS (SELECT * FROM m WHERE user_id IN (SELECT user_id FROM m WHERE stage = 3)),
u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS u FROM (SELECT DISTINCT user_id FROM f)), i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM (SELECT DISTINCT item_id FROM f))
SELECT u, i, stage FROM f JOIN u USING (user_id) JOIN i USING (item_id)
""", "stages")
def stage_table(spark, d):
    return C.stage_table(stages(spark, d), *UI, "stage", 45, 75)


@query("o02_seen_items", "SELECT DISTINCT user_id, item_id FROM stages", "stages")
def seen_items(spark, d):
    return C.seen_items(stages(spark, d), *UI)


# Factor tables from the embeddings: users take all vectors, items 200.., stages 400..; element 1 is the bias.
SCORED = """
, pr AS (SELECT DISTINCT user_id, item_id, stage FROM stages),
dl AS (SELECT p.user_id, p.item_id, p.stage, l, u.embedding[1]::DOUBLE + i.embedding[1]::DOUBLE + 0.1 AS bias,
  (SELECT sum(u.embedding[k]::DOUBLE * i.embedding[k]::DOUBLE * s.embedding[k]::DOUBLE) FROM range(1, 65) t(k)) * 2.0 AS x
  FROM pr p JOIN embeddings u ON u.vec_id = p.user_id % (SELECT count(*) FROM embeddings) JOIN embeddings i ON i.vec_id = 200 + p.item_id, (SELECT unnest(range(4)) AS l) JOIN embeddings s ON s.vec_id = 400 + l),
de AS (SELECT *, (greatest(x, 0) + ln(1 + exp(-abs(x)))) / 2.0 AS delta FROM dl),
sx AS (SELECT *, bias + sum(delta) OVER (PARTITION BY user_id, item_id, stage ORDER BY l DESC) AS score FROM de)
"""


def user_vector(vectors):
    """A user's vector: the id modulo the number of vectors."""
    return F.col("user_id") % vectors.agg(F.count(F.lit(1))).scalar()


def scored_pairs(spark, d, pairs):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    vectors = e.filter((F.col("vec_id") >= 400) & (F.col("vec_id") < 404)).orderBy("vec_id").collect()
    bias = F.get("vec", F.lit(0)).alias("bias")
    users = e.select(F.col("vec_id").alias("uid"), "vec", bias)
    items = e.filter("vec_id >= 200").select((F.col("vec_id") - 200).alias("item_id"), "vec", bias)
    rows = pairs.withColumn("uid", user_vector(e)).withColumn("item_id", F.col("item_id").cast("bigint"))
    return C.stage_scores(rows, users, items, [r["vec"] for r in vectors], "uid", "item_id", 0.1, 2.0).drop("uid")


@query("o03_chain_scores", SCORED + " SELECT user_id, item_id::BIGINT AS item_id, stage, l::INT AS target, ROUND(score, 6) AS score FROM sx", "stages")
def chain_scores(spark, d):
    rows = scored_pairs(spark, d, stages(spark, d).select(*UI, "stage").distinct())
    # outer, as Spark would else score every pair once more to see whether it has scores
    return rows.select(*UI, "stage", F.posexplode_outer("scores").alias("target", "score")).withColumn("score", rnd("score"))


@query("o04_edge_loss", SCORED + """
, w AS (SELECT user_id, item_id, stage, max(score) FILTER (WHERE l = stage) AS s, max(score) FILTER (WHERE l = stage + 1) AS sn, max(delta) FILTER (WHERE l = stage) AS dl FROM sx GROUP BY 1, 2, 3),
p AS (SELECT stage, 1 / (1 + exp(-s)) AS ps, CASE WHEN stage = 3 THEN 0 ELSE 1 / (1 + exp(-sn)) END AS pn, greatest(1 - exp(-dl), 1e-8) AS pc FROM w)
SELECT ROUND((SELECT avg(-ln(greatest(ps, 1e-8))) FROM p WHERE stage >= 2), 6) AS loss_pos, ROUND(avg(-(ln(greatest(1 - pn, 1e-8)) + ln(pc))), 6) AS loss_neg,
 ROUND((SELECT avg(-ln(greatest(ps, 1e-8))) FROM p WHERE stage >= 2) + avg(-(ln(greatest(1 - pn, 1e-8)) + ln(pc))), 6) AS loss, count(*) AS n FROM p WHERE stage < 2
""", "stages")
def edge_loss(spark, d):
    rows = scored_pairs(spark, d, stages(spark, d).select(*UI, "stage").distinct())
    return rounded(C.edge_loss(rows.filter("stage >= 2"), rows.filter("stage < 2"), "stage"), "loss_pos", "loss_neg", "loss")


def holdout(spark, d):
    held = cut_lineage(G.leave_one_out(stages(spark, d), "user_id", "stage", ["event_id"], 40, 40))
    test = held.filter("split = 'test'").select(*UI, "stage")
    return held, test


def test_candidates(spark, d, held, test):
    negatives = G.sample_negatives(test, cut_lineage(dense_index(held, "item_id")), held, *UI, NEG, 21)
    return R.candidates(test, negatives, *UI)


@query("k08_auc", HOLDOUT + ", te AS (SELECT user_id, item_id FROM held WHERE split = 'test')" + negatives_sql("held", f"SELECT DISTINCT user_id, {NEG} AS want FROM te", "held", 21) + """
, c AS (SELECT user_id, item_id, 1 AS positive FROM te UNION ALL SELECT user_id, item_id, 0 FROM neg),
s AS (SELECT c.*, list_dot_product(u.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS s FROM c JOIN embeddings u ON u.vec_id = user_id % (SELECT count(*) FROM embeddings) JOIN embeddings i ON i.vec_id = 200 + c.item_id)
SELECT n.user_id, ROUND(avg(CASE WHEN p.s > n.s THEN 1.0 ELSE 0 END), 6) AS auc FROM s n JOIN s p ON n.user_id = p.user_id WHERE p.positive = 1 AND n.positive = 0 GROUP BY 1
""", "stages")
def auc(spark, d):
    from prefmine.models.factors import score_pairs

    held, test = holdout(spark, d)
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    cand = test_candidates(spark, d, held, test).withColumn("uid", user_vector(e)).withColumn("iid", F.col("item_id") + 200)
    scored = score_pairs(cand, e.withColumnRenamed("vec_id", "uid"), e.withColumnRenamed("vec_id", "iid"), "uid", "iid", "s")
    return rounded(R.pairwise_auc(scored, "user_id", "s", "positive"), "auc")


@query("k11_stage_evaluation", HOLDOUT + ", te AS (SELECT user_id, item_id, stage FROM held WHERE split = 'test')" + negatives_sql("held", f"SELECT DISTINCT user_id, {NEG} AS want FROM te", "held", 21) + """
, c AS (SELECT user_id, item_id, 1 AS positive FROM te UNION ALL SELECT user_id, item_id, 0 FROM neg),
s AS (SELECT c.*, list_dot_product(u.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS s FROM c JOIN embeddings u ON u.vec_id = user_id % (SELECT count(*) FROM embeddings) JOIN embeddings i ON i.vec_id = 200 + c.item_id),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, positive DESC, item_id) AS r FROM s),
a AS (SELECT user_id, stage, (SELECT avg(CASE WHEN p.s > n.s THEN 1.0 ELSE 0 END) FROM s n, s p WHERE n.user_id = te.user_id AND p.user_id = te.user_id AND p.positive = 1 AND n.positive = 0) AS auc FROM te)
SELECT stage, count(*) AS users, ROUND(avg(auc), 6) AS auc, ROUND(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, ROUND(avg(CASE WHEN r <= 5 THEN 1 / log2(r + 1) ELSE 0 END), 6) AS ndcg_5
FROM a JOIN r USING (user_id) WHERE positive = 1 GROUP BY stage
""", "stages")
def stage_evaluation(spark, d):
    from prefmine.models.factors import score_pairs

    held, test = holdout(spark, d)
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    cand = test_candidates(spark, d, held, test).withColumn("uid", user_vector(e)).withColumn("iid", F.col("item_id") + 200)
    scored = cut_lineage(score_pairs(cand, e.withColumnRenamed("vec_id", "uid"), e.withColumnRenamed("vec_id", "iid"), "uid", "iid", "s"))
    return rounded(R.stage_report(scored, test, "user_id", "item_id", "stage", "s", "positive", 5), "auc", "recall_5", "ndcg_5")


@query("o05_stage_factors")
def stage_factors(spark, d):
    held, test = holdout(spark, d)
    models = C.fit_stage_factors(held.filter("split = 'train'"), *UI, "stage")
    cand = test_candidates(spark, d, held, test)
    scored = cut_lineage(C.monotone_scores(cand, models, [*UI, "positive"]).withColumn("s", F.get("scores", F.lit(3))))
    return rounded(R.stage_report(scored, test, "user_id", "item_id", "stage", "s", "positive", 5), "auc", "recall_5", "ndcg_5", digits=4)
