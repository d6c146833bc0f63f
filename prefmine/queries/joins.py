"""C: joins."""

from pyspark.sql import functions as F

from prefmine.core import rnd
from prefmine.datasets import interactions, reviews, table
from prefmine.operators import joins as J
from prefmine.queries.registry import query


@query("c01_inner_join", """
SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""", "")
def inner_join(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select("doc_id", "lang", "quality", "toxic")


@query("c02_unified_reviews", """
SELECT review_id, user_id, item_id, rating, ts::DATE AS day, p_name AS title, p_brand AS brand, p_type AS primary_genre, n_chars
FROM reviews JOIN part ON item_id = p_partkey WHERE rating > 0 AND review_text IS NOT NULL AND length(trim(review_text)) > 20
""", "reviews")
def unified_reviews(spark, d):
    items = table(spark, d, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("primary_genre")
    )
    rows = J.unify(reviews(spark, d), items, "item_id", "rating", "review_text")
    return rows.select(
        "review_id", "user_id", "item_id", "rating", F.to_date("ts").alias("day"), "title", "brand", "primary_genre", "n_chars"
    ).orderBy("day", "review_id")


@query("c03_match_rate", """
SELECT count(DISTINCT d.doc_id) AS total_ids, count(DISTINCT CASE WHEN l.doc_id IS NOT NULL THEN d.doc_id END) AS matched_ids,
       ROUND(count(DISTINCT CASE WHEN l.doc_id IS NOT NULL THEN d.doc_id END) / count(DISTINCT d.doc_id), 6) AS rate,
       count(DISTINCT CASE WHEN l.doc_id IS NOT NULL THEN d.doc_id END) / count(DISTINCT d.doc_id) < 0.4 AS low_rate
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""", "")
def match_rate(spark, d):
    return J.match_rate(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").withColumn("rate", rnd("rate"))


@query("c04_active_only", """
, u AS (SELECT * FROM interactions WHERE user_id IN (SELECT user_id FROM interactions GROUP BY user_id HAVING count(*) >= 35))
SELECT order_key, line_no, item_id, n_tokens FROM u WHERE item_id IN (SELECT item_id FROM u GROUP BY item_id HAVING count(*) >= 20)
""")
def active_only(spark, d):
    return J.active_only(interactions(spark, d), "user_id", "item_id", 35, 20).select("order_key", "line_no", "item_id", "n_tokens")


@query("c05_warm_or_cold", """
, r AS (SELECT *, ts < TIMESTAMP '1995-09-01' AS early FROM interactions)
SELECT order_key, line_no, item_id, n_tokens, uk AS user_known, ik AS item_known,
       CASE WHEN uk AND ik THEN 'warm' WHEN ik THEN 'cold_user' WHEN uk THEN 'cold_item' ELSE 'cold_both' END AS subset
FROM (SELECT *, user_id IN (SELECT user_id FROM r WHERE early) AS uk, item_id IN (SELECT item_id FROM r WHERE early) AS ik FROM r WHERE NOT early)
""")
def warm_or_cold(spark, d):
    rows = interactions(spark, d)
    early = F.col("ts") < F.lit("1995-09-01").cast("timestamp_ntz")
    out = J.warm_or_cold(rows.filter(~early), rows.filter(early), "user_id", "item_id")
    return out.select("order_key", "line_no", "item_id", "n_tokens", "user_known", "item_known", "subset")


@query("c06_composite_semi", """
SELECT r.order_key, r.line_no, r.item_id, r.n_tokens FROM interactions r
WHERE EXISTS (SELECT 1 FROM interactions t WHERE t.user_id = r.user_id AND t.item_id = r.item_id AND t.rating >= 4)
""")
def composite_semi(spark, d):
    rows = interactions(spark, d)
    return J.having(rows, rows.filter("rating >= 4"), ["user_id", "item_id"]).select("order_key", "line_no", "item_id", "n_tokens")


@query("c07_anti_join", """
SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)
""", "")
def anti_join(spark, d):
    bad = table(spark, d, "labels").filter("quality = 0")
    return J.not_having(table(spark, d, "documents"), bad, ["doc_id"]).select("doc_id", "lang")


@query("c08_lookup_default", """
, m AS (SELECT user_id, avg(rating) AS m FROM interactions WHERE ts < TIMESTAMP '1995-09-01' GROUP BY user_id)
SELECT order_key, line_no, item_id, n_tokens, ROUND(COALESCE(m, (SELECT avg(rating) FROM interactions)), 6) AS user_mean
FROM interactions LEFT JOIN m USING (user_id)
""")
def lookup_default(spark, d):
    rows = interactions(spark, d)
    means = rows.filter(F.col("ts") < F.lit("1995-09-01").cast("timestamp_ntz")).groupBy("user_id").agg(F.avg("rating").alias("m"))
    overall = rows.agg(F.avg("rating")).scalar()
    out = J.lookup(rows, means, "user_id", "m", overall, "user_mean")
    return out.select("order_key", "line_no", "item_id", "n_tokens", rnd("user_mean").alias("user_mean"))


@query("c09_shared_users", """
, ug AS (SELECT DISTINCT user_id, genre FROM interactions)
SELECT a.genre AS label_a, b.genre AS label_b, count(*) AS users_overlap FROM ug a JOIN ug b ON a.user_id = b.user_id AND a.genre < b.genre GROUP BY 1, 2
""")
def shared_users(spark, d):
    out = J.shared_users_by_pair(interactions(spark, d), "user_id", "genre")
    return out.orderBy(F.desc("users_overlap"), "label_a", "label_b")


@query("c10_first_attribute", """
, b AS (SELECT item_id, brand FROM interactions QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts, user_id, order_key, line_no, n_tokens) = 1)
SELECT doc_id, brand FROM documents LEFT JOIN b ON doc_id = item_id
""")
def first_attribute(spark, d):
    rows = interactions(spark, d).select(F.col("item_id").alias("doc_id"), "brand", "ts", "user_id", "order_key", "line_no", "n_tokens")
    order = [F.col(c) for c in ("ts", "user_id", "order_key", "line_no", "n_tokens")]
    return J.first_attribute(table(spark, d, "documents"), rows, "doc_id", order).select("doc_id", "brand")


@query("c11_results_with_labels", """
, g AS (SELECT brand, avg(rating) AS m, count(*) AS n FROM interactions WHERE rating >= 2 GROUP BY brand),
l AS (SELECT brand, count(DISTINCT item_id) AS items FROM interactions GROUP BY brand HAVING count(DISTINCT item_id) > 75)
SELECT brand, ROUND(m, 6) AS score, n, items FROM g LEFT JOIN l USING (brand) WHERE items IS NOT NULL
""")
def results_with_labels(spark, d):
    rows = interactions(spark, d)
    scores = rows.filter("rating >= 2").groupBy("brand").agg(rnd(F.avg("rating")).alias("score"), F.count(F.lit(1)).alias("n"))
    labels = rows.groupBy("brand").agg(F.countDistinct("item_id").alias("items")).filter("items > 75")
    return scores.join(labels, "brand", "left").dropna(subset=["items"])


@query("c12_item_cooccurrence", """
, p AS (SELECT DISTINCT user_id, item_id FROM reviews)
SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS common FROM p a JOIN p b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY 1, 2
""", "reviews")
def item_cooccurrence(spark, d):
    pairs = reviews(spark, d).select("user_id", "item_id").distinct()
    return J.item_pairs(pairs, "user_id", "item_id", {})


@query("c13_matrix_product", """
, a AS (SELECT user_id, genre, sum(rating) AS a FROM interactions GROUP BY 1, 2), b AS (SELECT genre, brand, avg(total_votes) AS b FROM interactions GROUP BY 1, 2)
SELECT user_id, brand, ROUND(sum(a * b), 6) AS value FROM a JOIN b USING (genre) GROUP BY 1, 2
""")
def matrix_product(spark, d):
    rows = interactions(spark, d)
    a = rows.groupBy("user_id", "genre").agg(F.sum("rating").alias("a"))
    b = rows.groupBy("genre", "brand").agg(F.avg("total_votes").alias("b"))
    return J.multiply(a, b, "genre", ["user_id"], ["brand"], "a", "b", "value").withColumn("value", rnd("value"))
