"""The two preparation flows from end to end."""

from pyspark.sql import functions as F

from prefmine.core import rnd
from prefmine.datasets import interactions
from prefmine.plans import books as B
from prefmine.plans import retail as R
from prefmine.queries.profiles import rounded
from prefmine.queries.registry import query
from prefmine.queries.sampling import u
from prefmine.queries.sources import retail

_RETAIL = """
, r AS (SELECT order_key || '-' || line_no AS review_id, user_id::VARCHAR AS customer_id, item_id::VARCHAR AS product_id, order_key::VARCHAR AS product_parent, brand AS product_category,
 CASE WHEN n_tokens = 7 THEN NULL ELSE rating END AS star_rating, helpful_votes, CASE WHEN total_votes = 3 THEN NULL ELSE total_votes END AS tv, verified AS verified_purchase, length(title)::INT + 19 AS review_length,
 n_tokens, ts::DATE AS review_date FROM interactions WHERE n_tokens <> 9),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY product_id, product_category, customer_id, star_rating NULLS FIRST, helpful_votes, tv NULLS FIRST) = 1),
c AS (SELECT *, COALESCE(tv, 0) AS total_votes, CASE WHEN COALESCE(tv, 0) > 0 THEN helpful_votes / tv ELSE 0 END AS helpful_ratio FROM f WHERE product_category IN ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#34'))
"""


def _raw(spark, d):
    rows = interactions(spark, d).select("n_tokens", F.concat_ws("-", "order_key", "line_no", "item_id", "n_tokens").alias("__id"))
    raw = retail(spark, d).join(rows, F.col("review_id") == F.col("__id"))
    return raw.withColumns({
        "review_id": F.concat_ws("-", F.split("__id", "-")[0], F.split("__id", "-")[1]),
        "star_rating": F.when(F.col("n_tokens") == 7, "five").otherwise(F.col("star_rating").cast("string")),
        "total_votes": F.when(F.col("total_votes") == 3, "").otherwise(F.col("total_votes").cast("string")),
        "review_date": F.when(F.col("n_tokens") == 9, F.date_format("review_date", "dd/MM/yyyy")).otherwise(F.col("review_date").cast("string")),
    }).drop("__id", "n_tokens")


def _clean(spark, d):
    return R.clean(_raw(spark, d), ["Brand#11", "Brand#12", "Brand#23", "Brand#34"], ["product_id", "product_category", "customer_id", "star_rating", "helpful_votes", "total_votes"])


@query("retail_clean_reviews", _RETAIL + """
SELECT review_id, customer_id, product_id, star_rating, helpful_votes, total_votes, verified_purchase, 0 AS vine, ROUND(helpful_ratio, 6) AS helpful_ratio, review_length, review_date FROM c
""")
def retail_clean_reviews(spark, d):
    out = _clean(spark, d).withColumn("helpful_ratio", rnd("helpful_ratio"))
    return out.select("review_id", "customer_id", "product_id", "star_rating", "helpful_votes", "total_votes", "verified_purchase", "vine", "helpful_ratio", "review_length", "review_date")


@query("retail_balanced_reviews", _RETAIL + f"""
, n AS (SELECT product_category, count(*) AS n FROM c GROUP BY 1)
SELECT review_id, product_category FROM c JOIN n USING (product_category) WHERE {u(42, 'review_id')} < 500.0 / n
""")
def retail_balanced_reviews(spark, d):
    return R.balanced(_clean(spark, d), 500).select("review_id", "product_category")


_BOOKS = """
, s AS (SELECT user_id, count(*) AS user_review_count, count(DISTINCT genre) AS user_genre_count, count(DISTINCT genre) >= 3 AS is_bridge_user, count(*) FILTER (WHERE year(ts) < 1999) >= 5 AS ok FROM interactions GROUP BY 1),
k AS (SELECT * FROM interactions WHERE rating > 1 AND n_tokens >= 10), c AS (SELECT genre, CASE WHEN quantile_cont(total_votes, 0.99) = 0 THEN 1.0 ELSE quantile_cont(total_votes, 0.99) END AS cap FROM k GROUP BY 1),
b AS (SELECT k.*, order_key || '-' || line_no || '-' || item_id || '-' || n_tokens AS review_id, ln(1 + least(total_votes, cap)) AS vote_weight, user_review_count, user_genre_count, is_bridge_user,
 CASE WHEN year(ts) = 1999 THEN 'val' WHEN year(ts) = 2000 THEN 'test' ELSE 'train' END AS split FROM k JOIN c USING (genre) JOIN s USING (user_id) WHERE ok)
"""


def _books(spark, d):
    """Interactions as unified book reviews: one word per token, ratings and votes as text, dates in raw form."""
    c = F.col
    day = F.concat(F.lit("Thu "), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("ts", "yyyy"))
    unified = interactions(spark, d).select(
        F.concat_ws("-", "order_key", "line_no", "item_id", "n_tokens").alias("review_id"), "user_id", c("item_id").alias("book_id"),
        F.when(c("rating") > 1, c("rating").cast("string")).otherwise("none").alias("rating"),
        F.concat(F.lit("<b>"), F.array_join(F.array_repeat(F.lit("so &amp;so"), c("n_tokens").cast("int")), "<br/>"), F.lit("</b>")).alias("review_text"),
        c("total_votes").cast("string").alias("n_votes"), F.lit("").alias("n_comments"), day.alias("date_added"), c("genre").alias("primary_genre"), "n_tokens",
    )
    return B.prepared(unified, (1999,), 2000, 2000, 3, 5, 1999, 20)


@query("books_prepared_reviews", _BOOKS + """
SELECT review_id, user_id, item_id AS book_id, CAST(rating AS DOUBLE) AS rating, total_votes AS n_votes, 0 AS n_comments, n_tokens * 2 AS review_token_count, ROUND(vote_weight, 6) AS vote_weight,
 ROUND(vote_weight * rating / 5.0, 6) AS edge_weight, user_review_count, user_genre_count, is_bridge_user, split FROM b
""")
def books_prepared_reviews(spark, d):
    out = rounded(_books(spark, d), "vote_weight", "edge_weight")
    return out.select("review_id", "user_id", "book_id", "rating", "n_votes", "n_comments", "review_token_count", "vote_weight", "edge_weight", "user_review_count", "user_genre_count", "is_bridge_user", "split")


@query("books_topic_sample", _BOOKS + f"""
SELECT review_id, genre AS primary_genre FROM b WHERE split = 'train'
QUALIFY row_number() OVER (PARTITION BY genre ORDER BY -ln({u(42, 'review_id')} + power(2.0, -49)) / (vote_weight + 1e-6), review_id) <= 300
""")
def books_topic_sample(spark, d):
    return B.topic_sample(_books(spark, d), 300).select("review_id", "primary_genre")
