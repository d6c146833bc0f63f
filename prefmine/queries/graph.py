"""H and S: cores, dense ids and splits."""

from pyspark.sql import functions as F

from prefmine.core import rnd
from prefmine.datasets import KEY, ORDER, interactions, stages
from prefmine.operators import graph as H
from prefmine.operators import joins as J
from prefmine.queries.registry import query

K = ", ".join(KEY)
O = ", ".join(ORDER)


def core_sql(k, rounds=9):
    """The k-core with its rounds written out."""
    out = [f", c0 AS MATERIALIZED (SELECT * FROM interactions)"]
    for r in range(1, rounds + 1):
        p = f"c{r - 1}"
        out.append(f""", c{r} AS MATERIALIZED (SELECT * FROM {p} WHERE user_id IN (SELECT user_id FROM {p} GROUP BY 1 HAVING count(*) >= {k})
 AND item_id IN (SELECT item_id FROM {p} GROUP BY 1 HAVING count(*) >= {k}))""")
    return "\n".join(out) + f", core AS (SELECT * FROM c{rounds})"


def split_sql(src, share, out="sp"):
    return f""", {out} AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {O}) <= floor({share} * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM {src})"""


@query("h01_k_core", core_sql(20) + f" SELECT {K}, user_id FROM core")
def k_core(spark, d):
    return H.k_core(interactions(spark, d), "user_id", "item_id", 20).select(*KEY, "user_id")


@query("h02_min_interactions", f"""
SELECT {K} FROM interactions WHERE user_id IN (SELECT user_id FROM interactions GROUP BY 1 HAVING count(*) >= 30) AND item_id IN (SELECT item_id FROM interactions GROUP BY 1 HAVING count(*) >= 30)
""")
def min_interactions(spark, d):
    return H.min_interactions(interactions(spark, d), "user_id", "item_id", 30, 30).select(*KEY)


@query("h03_final_stage", """
SELECT event_id FROM stages WHERE user_id IN (SELECT user_id FROM stages WHERE stage = 3)
""", "stages")
def final_stage(spark, d):
    return H.with_final_stage(stages(spark, d), "user_id", "stage").select("event_id")


@query("h04_dense_index", "SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT user_id FROM interactions)")
def dense_index(spark, d):
    return H.dense_index(interactions(spark, d), "user_id")


@query("h04_encoded_rows", """
, u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS u FROM (SELECT DISTINCT user_id FROM interactions)),
i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM (SELECT DISTINCT item_id FROM interactions))
SELECT u, i, count(*) AS n FROM interactions JOIN u USING (user_id) JOIN i USING (item_id) GROUP BY 1, 2
""")
def encoded_rows(spark, d):
    rows = interactions(spark, d).select("user_id", "item_id")
    coded = H.encode(H.encode(rows, "user_id", H.dense_index(rows, "user_id"), "u"), "item_id", H.dense_index(rows, "item_id"), "i")
    return coded.groupBy("u", "i").agg(F.count(F.lit(1)).alias("n"))


@query("h05_stage_label", f"""
SELECT {K}, CAST(CASE WHEN r >= 4 THEN 3 WHEN r > 0 THEN 2 WHEN verified = 1 THEN 1 ELSE 0 END AS INT) AS stage FROM (SELECT *, rating - 2 AS r FROM interactions)
""")
def stage_label(spark, d):
    rows = interactions(spark, d)
    return rows.select(*KEY, H.stage_of(F.col("verified"), F.col("rating") - 2).alias("stage"))


@query("s01_temporal_split", split_sql("interactions", 0.8) + f" SELECT {K}, split FROM sp")
def temporal_split(spark, d):
    return H.temporal_split(interactions(spark, d), 0.8, ORDER).select(*KEY, "split")


@query("s02_inner_validation", split_sql("interactions", 0.8, "a") + ", tr AS (SELECT * EXCLUDE (split) FROM a WHERE split = 'train')" + split_sql("tr", 0.9) + f" SELECT {K}, split FROM sp")
def inner_validation(spark, d):
    train = H.temporal_split(interactions(spark, d), 0.8, ORDER).filter("split = 'train'").drop("split")
    return H.temporal_split(train, 0.9, ORDER).select(*KEY, "split")


@query("s03_split_diagnostics", split_sql("interactions", 0.1) + """
, t AS (SELECT *, user_id IN (SELECT user_id FROM sp WHERE split = 'train') AS uk, item_id IN (SELECT item_id FROM sp WHERE split = 'train') AS ik FROM sp WHERE split = 'test')
SELECT CASE WHEN uk AND ik THEN 'warm' WHEN ik THEN 'cold_user' WHEN uk THEN 'cold_item' ELSE 'cold_both' END AS subset, count(*) AS n,
       ROUND(count(*) / sum(count(*)) OVER (), 6) AS share FROM t GROUP BY 1
""")
def split_diagnostics(spark, d):
    rows = H.temporal_split(interactions(spark, d), 0.1, ORDER)
    test = J.warm_or_cold(rows.filter("split = 'test'"), rows.filter("split = 'train'"), "user_id", "item_id")
    return H.split_diagnostics(test, "subset").withColumn("share", rnd("share"))


@query("s04_validation_index", split_sql("interactions", 0.8) + f"""
SELECT CAST(row_number() OVER (ORDER BY {O}) - 1 AS BIGINT) AS oof_row_id, user_id, item_id, rating, ts::DATE AS day FROM sp WHERE split = 'test'
""")
def validation_index(spark, d):
    val = H.temporal_split(interactions(spark, d), 0.8, ORDER).filter("split = 'test'")
    return H.validation_index(val.withColumn("day", F.to_date("ts")), ORDER, ["user_id", "item_id", "rating", "day"])
