"""E and F: window functions, sorting, limits and sets."""

from pyspark.sql import functions as F

from prefmine.core import rnd
from prefmine.datasets import KEY, ORDER, interactions, reviews, stages, table
from prefmine.operators import profiles as P
from prefmine.operators import sets as X
from prefmine.operators import windows as W
from prefmine.core import top_per_key
from prefmine.queries.profiles import rounded
from prefmine.queries.registry import query

_TAIL = """
, b AS (SELECT item_id, count(*) AS n FROM interactions GROUP BY item_id),
r AS (SELECT n AS n_reviews, row_number() OVER (ORDER BY n DESC, item_id) AS item_rank, sum(n) OVER () AS t,
      sum(n) OVER (ORDER BY n DESC, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, count(*) OVER () AS k FROM b),
x AS (SELECT item_rank, n_reviews, item_rank * 100.0 / k AS pct_items, c * 100.0 / t AS pct_reviews FROM r)
"""


@query("e01_long_tail", _TAIL + "SELECT item_rank, n_reviews, ROUND(pct_items, 6) AS pct_items, ROUND(pct_reviews, 6) AS pct_reviews FROM x")
def long_tail(spark, d):
    return rounded(W.long_tail(interactions(spark, d), "item_id"), "pct_items", "pct_reviews")


@query("e01_share_at_top", _TAIL + """SELECT p::INT AS top_pct, (SELECT ROUND(max(pct_reviews), 6) FROM x WHERE pct_items <= p) AS pct_reviews FROM (VALUES (1), (5), (10), (20)) v(p)""")
def share_at_top(spark, d):
    return rounded(W.share_at(W.long_tail(interactions(spark, d), "item_id"), [1, 5, 10, 20]), "pct_reviews")


@query("e02_moving_average", """
, m AS (SELECT date_trunc('month', ts)::DATE AS month, count(*) AS reviews, avg(rating) AS r FROM interactions GROUP BY 1)
SELECT month, reviews, ROUND(avg(reviews) OVER w, 6) AS reviews_ma3, ROUND(avg(r) OVER w, 6) AS rating_ma3 FROM m WINDOW w AS (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
""")
def moving_average(spark, d):
    monthly = P.monthly_activity(interactions(spark, d), "ts", "user_id", "rating")
    out = P.moving_average(monthly, "month", ["reviews", "avg_rating"])
    return out.select("month", "reviews", rnd("reviews_ma3").alias("reviews_ma3"), rnd("avg_rating_ma3").alias("rating_ma3"))


@query("e03_running_sums", """
, u AS (SELECT user_id, count(*) AS n FROM interactions GROUP BY 1), dist AS (SELECT n AS n_reviews, count(*) AS n_entities FROM u GROUP BY 1)
SELECT n_reviews, n_entities, CAST(sum(n_entities) OVER (ORDER BY n_reviews) AS BIGINT) AS running,
       CAST(sum(n_entities) OVER (ORDER BY n_reviews DESC) AS BIGINT) AS remaining FROM dist
""")
def running_sums(spark, d):
    return W.running_sums(P.count_distribution(interactions(spark, d), "user_id"), "n_reviews", "n_entities")


@query("e04_time_position", """
SELECT order_key, line_no, item_id, n_tokens, row_number() OVER (ORDER BY ts, user_id, item_id, order_key, line_no, n_tokens) AS position FROM interactions
""")
def time_position(spark, d):
    from prefmine.core import global_position

    rows = interactions(spark, d).select(*dict.fromkeys(ORDER + KEY))
    return global_position(rows, [F.col(c) for c in ORDER]).select(*KEY, "position")


@query("e05_previous_row", """
SELECT doc_id, source, n_chars, lag(n_chars) OVER w AS prev_chars FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id)
""", "")
def previous_row(spark, d):
    from prefmine.operators.dedup import previous_in_order

    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    bucket = F.floor(F.log2(F.col("n_chars") + 1) * 4)
    return previous_in_order(docs, ["source"], bucket, ["n_chars", "doc_id"], {"prev_chars": "n_chars"})


@query("e06_first_row", """
SELECT item_id, user_id, rating, order_key FROM interactions QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts, user_id, order_key, line_no, n_tokens) = 1
""")
def first_row(spark, d):
    rows = interactions(spark, d)
    return X.first_per_key(rows, ["item_id"], ["ts", "user_id", "order_key", "line_no", "n_tokens"]).select("item_id", "user_id", "rating", "order_key")


@query("e07_top_per_user", """
SELECT user_id, item_id, order_key, line_no, n_tokens FROM interactions
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, total_votes DESC, item_id, order_key, line_no, n_tokens) <= 10
""")
def top_per_user(spark, d):
    order = [F.desc("rating"), F.desc("total_votes"), *[F.asc(c) for c in ("item_id", "order_key", "line_no", "n_tokens")]]
    return top_per_key(interactions(spark, d), ["user_id"], order, 10).select("user_id", "item_id", "order_key", "line_no", "n_tokens")


@query("e08_suffix_sums", """
, c AS (SELECT user_id, stage, count(*) AS n FROM stages GROUP BY 1, 2)
SELECT user_id, s::INT AS stage, CAST((SELECT COALESCE(sum(n), 0) FROM c c2 WHERE c2.user_id = u.user_id AND c2.stage >= s) AS DOUBLE) AS at_least
FROM (SELECT DISTINCT user_id FROM stages) u, range(4) r(s)
""", "stages")
def suffix_sums(spark, d):
    per_user = stages(spark, d).groupBy("user_id").agg(
        F.array(*[F.count_if(F.col("stage") == s).cast("double") for s in range(4)]).alias("n")
    )
    return per_user.select("user_id", F.posexplode(W.suffix_sums(F.col("n"))).alias("stage", "at_least"))


@query("f01_sorted", """
SELECT review_id, ts::DATE AS day, rating FROM reviews ORDER BY day, rating DESC, review_id
""", "reviews")
def sorted_rows(spark, d):
    return reviews(spark, d).select("review_id", F.to_date("ts").alias("day"), "rating").orderBy("day", F.desc("rating"), "review_id")


@query("f02_top_rows", """
SELECT brand, genre, count(*) AS n FROM interactions GROUP BY 1, 2 ORDER BY n DESC, brand, genre LIMIT 10
""")
def top_rows(spark, d):
    counts = interactions(spark, d).groupBy("brand", "genre").agg(F.count(F.lit(1)).alias("n"))
    return X.top_rows(counts, [F.desc("n"), "brand", "genre"], 10)


@query("f03_union_all", """
SELECT 'order' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'event', count(*) FROM events UNION ALL SELECT 'document', count(*) FROM documents
""", "")
def union_all(spark, d):
    parts = [table(spark, d, t).select(F.lit(k).alias("kind")) for k, t in (("order", "orders"), ("event", "events"), ("document", "documents"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("f04_distinct", "SELECT DISTINCT user_id, genre FROM interactions")
def distinct_rows(spark, d):
    return interactions(spark, d).select("user_id", "genre").distinct()


_SETS = """
, a AS (SELECT user_id FROM interactions WHERE year(ts) = 1996), b AS (SELECT user_id FROM interactions WHERE year(ts) = 2000)
"""


@query("f05_common_ids", _SETS + "SELECT user_id FROM a INTERSECT SELECT user_id FROM b")
def common_ids(spark, d):
    rows = interactions(spark, d)
    return X.common_ids(rows.filter(F.year("ts") == 1996), rows.filter(F.year("ts") == 2000), "user_id")


@query("f05_missing_ids", _SETS + "SELECT user_id FROM a EXCEPT SELECT user_id FROM b")
def missing_ids(spark, d):
    rows = interactions(spark, d)
    return X.missing_ids(rows.filter(F.year("ts") == 1996), rows.filter(F.year("ts") == 2000), "user_id")
