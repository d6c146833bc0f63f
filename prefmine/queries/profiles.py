"""D: aggregations and profiles."""

from pyspark.sql import functions as F

from prefmine.core import rnd
from prefmine.datasets import interactions, reviews, stages
from prefmine.functions import scalars as S
from prefmine.functions.text import word_count
from prefmine.operators import profiles as P
from prefmine.queries.registry import query


def rounded(df, *columns, digits=6):
    for c in columns:
        df = df.withColumn(c, rnd(c, digits))
    return df


@query("d01_overview", """
SELECT count(*) AS total_reviews, count(DISTINCT user_id) AS unique_users, count(DISTINCT item_id) AS unique_items, min(ts)::DATE AS earliest_date,
       max(ts)::DATE AS latest_date, ROUND(avg(rating), 6) AS avg_rating, count(*) FILTER (WHERE review_text IS NOT NULL AND length(trim(review_text)) > 0) AS reviews_with_text,
       ROUND(count(*) FILTER (WHERE review_text IS NOT NULL AND length(trim(review_text)) > 0) * 100.0 / count(*), 6) AS pct_reviews_with_text FROM reviews
""", "reviews")
def overview(spark, d):
    return rounded(P.overview(reviews(spark, d), "user_id", "item_id", "rating", "ts", "review_text"), "avg_rating", "pct_reviews_with_text")


@query("d02_density", """
, a AS (SELECT count(*) AS n_reviews, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items FROM interactions)
SELECT *, ROUND(n_reviews / n_users, 6) AS avg_per_user, ROUND(n_reviews / n_items, 6) AS avg_per_item,
       ROUND(n_reviews / (n_users * n_items), 8) AS density, ROUND(1 - n_reviews / (n_users * n_items), 8) AS sparsity FROM a
""")
def density(spark, d):
    out = P.density(interactions(spark, d), "user_id", "item_id")
    return rounded(rounded(out, "avg_per_user", "avg_per_item"), "density", "sparsity", digits=8)


@query("d03_rating_histogram", """
, r AS (SELECT rating, count(*) AS n FROM interactions WHERE rating BETWEEN 1 AND 5 GROUP BY rating)
SELECT rating, n, ROUND(n * 100.0 / sum(n) OVER (), 6) AS pct, ROUND(sum(n) OVER (ORDER BY rating) * 100.0 / sum(n) OVER (), 6) AS cum_pct,
       ROUND(sum(rating * n) OVER () / sum(n) OVER (), 6) AS mean_rating FROM r
""")
def rating_histogram(spark, d):
    return rounded(P.rating_histogram(interactions(spark, d), "rating"), "pct", "cum_pct", "mean_rating")


@query("d04_sentiment_shares", """
SELECT count(*) AS total, count(*) FILTER (WHERE rating >= 4) AS positive, count(*) FILTER (WHERE rating <= 2) AS negative,
       count(*) FILTER (WHERE rating = 5) AS five_star, count(*) FILTER (WHERE rating = 1) AS one_star,
       ROUND(count(*) FILTER (WHERE rating >= 4) * 100.0 / count(*), 6) AS pct_positive FROM interactions
""")
def sentiment_shares(spark, d):
    return rounded(P.sentiment_shares(interactions(spark, d), "rating"), "pct_positive")


_DESCRIBE = """
, u AS (SELECT {e} AS e, count(*) AS n FROM interactions GROUP BY 1)
SELECT count(*) AS entities, ROUND(avg(n), 6) AS mean_reviews, ROUND(stddev_samp(n), 6) AS std_reviews, min(n) AS min_reviews, max(n) AS max_reviews,
       ROUND(quantile_cont(n, 0.5), 6) AS p50, ROUND(quantile_cont(n, 0.75), 6) AS p75, ROUND(quantile_cont(n, 0.9), 6) AS p90,
       ROUND(quantile_cont(n, 0.95), 6) AS p95, ROUND(quantile_cont(n, 0.99), 6) AS p99, ROUND(count(*) FILTER (WHERE n = 1) * 100.0 / count(*), 6) AS pct_one_review FROM u
"""
_PROBS = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query("d05_counts_per_user", _DESCRIBE.format(e="user_id"))
def counts_per_user(spark, d):
    out = P.describe_counts(interactions(spark, d), "user_id", _PROBS)
    return rounded(out, "mean_reviews", "std_reviews", "pct_one_review", *_PROBS)


@query("d06_user_segments", """
, u AS (SELECT user_id, count(*) AS n FROM reviews GROUP BY user_id)
SELECT count(*) FILTER (WHERE n = 1) AS users_1_review, count(*) FILTER (WHERE n BETWEEN 2 AND 5) AS users_2to5, count(*) FILTER (WHERE n > 5) AS users_5plus, count(*) AS total_users FROM u
""", "reviews")
def user_segments(spark, d):
    return P.user_segments(reviews(spark, d), "user_id")


@query("d07_category_profile", """
SELECT brand, count(*) AS reviews, count(DISTINCT item_id) AS items, count(DISTINCT user_id) AS users, ROUND(avg(rating), 6) AS avg_rating FROM interactions GROUP BY brand
""")
def category_profile(spark, d):
    out = P.category_profile(interactions(spark, d), "brand", "user_id", "item_id", "rating")
    return rounded(out, "avg_rating").orderBy(F.desc("reviews"), "brand")


@query("d08_verified", "SELECT verified, count(*) AS reviews, ROUND(avg(rating), 6) AS avg_rating FROM interactions GROUP BY verified")
def verified(spark, d):
    return rounded(P.group_mean(interactions(spark, d), "verified", "rating"), "avg_rating")


@query("d09_length_percentiles", """
SELECT ROUND(quantile_cont(length(review_text), 0.5), 6) AS p50, ROUND(quantile_cont(length(review_text), 0.75), 6) AS p75, ROUND(quantile_cont(length(review_text), 0.9), 6) AS p90,
       ROUND(quantile_cont(length(review_text), 0.95), 6) AS p95, ROUND(quantile_cont(length(review_text), 0.99), 6) AS p99, ROUND(quantile_cont(length(review_text), 0.999), 6) AS p999 FROM reviews
""", "reviews")
def length_percentiles(spark, d):
    from prefmine.core import value_percentiles

    probs = {**{k: v for k, v in _PROBS.items()}, "p999": 0.999}
    out = value_percentiles(reviews(spark, d).select(F.length("review_text").alias("len")), [], "len", probs)
    return rounded(out, *probs)


@query("d10_item_distribution", _DESCRIBE.format(e="item_id"))
def item_distribution(spark, d):
    out = P.describe_counts(interactions(spark, d), "item_id", _PROBS)
    return rounded(out, "mean_reviews", "std_reviews", "pct_one_review", *_PROBS)


@query("d11_cold_start", """
, u AS (SELECT 'users' AS entity, count(*) AS n FROM reviews GROUP BY user_id), i AS (SELECT 'items' AS entity, count(*) AS n FROM reviews GROUP BY item_id),
a AS (SELECT * FROM u UNION ALL SELECT * FROM i)
SELECT entity, count(*) AS n_entities, count(*) FILTER (WHERE n < 5) AS n_lt5, count(*) FILTER (WHERE n < 10) AS n_lt10, ROUND(avg(n), 6) AS avg_reviews,
       ROUND(median(n), 6) AS median_reviews, ROUND(count(*) FILTER (WHERE n < 5) * 100.0 / count(*), 6) AS pct_lt5, ROUND(count(*) FILTER (WHERE n < 10) * 100.0 / count(*), 6) AS pct_lt10
FROM a GROUP BY entity
""", "reviews")
def cold_start(spark, d):
    out = P.cold_start(reviews(spark, d), {"users": "user_id", "items": "item_id"})
    return rounded(out, "avg_reviews", "median_reviews", "pct_lt5", "pct_lt10")


@query("d12_bucket_shares", """
, u AS (SELECT user_id, count(*) AS n FROM reviews GROUP BY user_id),
b AS (SELECT CASE WHEN n <= 1 THEN 'new (0-1)' WHEN n <= 4 THEN 'cold (2-4)' WHEN n <= 19 THEN 'medium (5-19)' ELSE 'warm (>=20)' END AS bucket FROM u)
SELECT bucket, count(*) AS n, ROUND(count(*) / sum(count(*)) OVER (), 6) AS share FROM b GROUP BY bucket
""", "reviews")
def bucket_shares(spark, d):
    return rounded(P.bucket_shares(reviews(spark, d), "user_id", S.ACTIVITY_BUCKETS), "share")


@query("d13_yearly_activity", """
SELECT year(ts)::INT AS yr, count(*) AS reviews, count(DISTINCT user_id) AS active_users, ROUND(avg(rating), 6) AS avg_rating,
       ROUND(count(*) FILTER (WHERE length(trim(review_text)) > 0) * 100.0 / count(*), 6) AS pct_has_text FROM reviews GROUP BY 1
""", "reviews")
def yearly_activity(spark, d):
    return rounded(P.yearly_activity(reviews(spark, d), "ts", "user_id", "rating", "review_text"), "avg_rating", "pct_has_text").orderBy("yr")


@query("d14_first_year_cohorts", """
, u AS (SELECT user_id, min(year(ts))::INT AS yr FROM interactions GROUP BY user_id), n AS (SELECT yr, count(*) AS new_users FROM u GROUP BY yr)
SELECT yr, new_users, CAST(sum(new_users) OVER (ORDER BY yr) AS BIGINT) AS cumulative_users FROM n
""")
def first_year_cohorts(spark, d):
    return P.first_year_cohorts(interactions(spark, d), "ts", "user_id")


@query("d15_monthly_activity", """
SELECT date_trunc('month', ts)::DATE AS month, count(*) AS reviews, ROUND(avg(rating), 6) AS avg_rating, count(DISTINCT user_id) AS active_users FROM interactions GROUP BY 1
""")
def monthly_activity(spark, d):
    return rounded(P.monthly_activity(interactions(spark, d), "ts", "user_id", "rating"), "avg_rating").orderBy("month")


@query("d15_monthly_activity_years", """
SELECT date_trunc('month', ts)::DATE AS month, count(*) AS reviews, ROUND(avg(rating), 6) AS avg_rating, count(DISTINCT user_id) AS active_users
FROM interactions WHERE year(ts) BETWEEN 1996 AND 1999 GROUP BY 1
""")
def monthly_activity_years(spark, d):
    rows = interactions(spark, d).filter(F.year("ts").between(1996, 1999))
    return rounded(P.monthly_activity(rows, "ts", "user_id", "rating"), "avg_rating").orderBy("month")


@query("d16_positivity_by_year", """
SELECT year(ts)::INT AS yr, count(*) AS reviews, ROUND(count(*) FILTER (WHERE rating >= 4) * 100.0 / count(*), 6) AS pct_4plus,
       ROUND(count(*) FILTER (WHERE rating = 5) * 100.0 / count(*), 6) AS pct_5star, ROUND(avg(rating), 6) AS avg_rating FROM interactions WHERE rating BETWEEN 1 AND 5 GROUP BY 1
""")
def positivity_by_year(spark, d):
    return rounded(P.positivity_by_year(interactions(spark, d), "ts", "rating"), "pct_4plus", "pct_5star", "avg_rating").orderBy("yr")


@query("d17_rating_by_year", "SELECT year(ts)::INT AS yr, rating, count(*) AS n FROM interactions WHERE rating BETWEEN 1 AND 5 GROUP BY 1, 2")
def rating_by_year(spark, d):
    return P.rating_by_year(interactions(spark, d), "ts", "rating")


@query("d17_rating_drift", """
, y AS (SELECT year(ts)::INT AS yr, rating, count(*) AS n FROM interactions GROUP BY 1, 2),
p AS (SELECT yr, COALESCE(sum(n) FILTER (WHERE rating = 1), 0) * 100.0 / sum(n) AS pct_1, COALESCE(sum(n) FILTER (WHERE rating = 2), 0) * 100.0 / sum(n) AS pct_2,
 COALESCE(sum(n) FILTER (WHERE rating = 3), 0) * 100.0 / sum(n) AS pct_3, COALESCE(sum(n) FILTER (WHERE rating = 4), 0) * 100.0 / sum(n) AS pct_4,
 COALESCE(sum(n) FILTER (WHERE rating = 5), 0) * 100.0 / sum(n) AS pct_5, sum(rating * n) / sum(n) AS m FROM y GROUP BY yr)
SELECT yr, ROUND(pct_1, 6) AS pct_1, ROUND(pct_2, 6) AS pct_2, ROUND(pct_3, 6) AS pct_3, ROUND(pct_4, 6) AS pct_4, ROUND(pct_5, 6) AS pct_5,
       ROUND(m, 6) AS mean_rating, ROUND(m - first(m) OVER (ORDER BY yr), 6) + 0.0 AS drift FROM p
""")
def rating_drift(spark, d):
    out = P.rating_year_pivot(P.rating_by_year(interactions(spark, d), "ts", "rating"), "rating")
    return rounded(out, *[f"pct_{s}" for s in range(1, 6)], "mean_rating", "drift").orderBy("yr")


@query("d18_genre_profile", """
SELECT genre, count(*) AS reviews, count(DISTINCT item_id) AS items, count(DISTINCT user_id) AS users, ROUND(avg(rating), 6) AS avg_rating,
       ROUND(avg(length(review_text)), 6) AS avg_char_len FROM reviews WHERE genre IS NOT NULL GROUP BY genre
""", "reviews")
def genre_profile(spark, d):
    rows = reviews(spark, d).filter(F.col("genre").isNotNull())
    out = P.category_profile(rows, "genre", "user_id", "item_id", "rating", {"avg_char_len": F.avg(F.length("review_text"))})
    return rounded(out, "avg_rating", "avg_char_len")


@query("d18_genre_rating_shares", """
SELECT genre, rating, count(*) AS n, ROUND(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY genre), 6) AS pct FROM interactions GROUP BY genre, rating
""")
def genre_rating_shares(spark, d):
    return rounded(P.shares_within(interactions(spark, d), "genre", "rating"), "pct")


@query("d18_genre_breadth", """
, u AS (SELECT user_id, count(DISTINCT genre) AS n_labels FROM interactions GROUP BY user_id)
SELECT n_labels, count(*) AS users, ROUND(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct_users FROM u GROUP BY n_labels
""")
def genre_breadth(spark, d):
    return rounded(P.breadth(interactions(spark, d), "user_id", "genre"), "pct_users")


@query("d18_bridge_profile", """
, u AS (SELECT user_id, count(DISTINCT genre) >= 6 AS is_bridge_user FROM interactions GROUP BY user_id)
SELECT is_bridge_user, count(*) AS reviews, count(DISTINCT item_id) AS items, count(DISTINCT user_id) AS users, ROUND(avg(rating), 6) AS avg_rating
FROM interactions JOIN u USING (user_id) GROUP BY 1
""")
def bridge_profile(spark, d):
    rows = interactions(spark, d)
    flags = P.user_stats(rows, "user_id", "genre", "ts", bridge_from=6).select("user_id", "is_bridge_user")
    out = P.category_profile(rows.join(flags, "user_id"), "is_bridge_user", "user_id", "item_id", "rating")
    return rounded(out, "avg_rating")


@query("d18_split_profile", """
, s AS (SELECT *, CASE WHEN year(ts) = 1999 THEN 'val' WHEN year(ts) >= 2000 THEN 'test' ELSE 'train' END AS split FROM interactions)
SELECT split, count(*) AS reviews, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, min(ts)::DATE AS earliest, max(ts)::DATE AS latest, ROUND(avg(rating), 6) AS avg_rating FROM s GROUP BY split
""")
def split_profile(spark, d):
    rows = interactions(spark, d).withColumn("split", S.calendar_split("ts", (1999,), 2000, None))
    return rounded(P.split_profile(rows, "split", "user_id", "item_id", "ts", "rating"), "avg_rating")


@query("d19_rating_bias", """
, i AS (SELECT item_id, count(*) AS n, avg(rating) AS m FROM interactions GROUP BY item_id),
t AS (SELECT *, CASE WHEN n <= 10 THEN '1–10' WHEN n <= 50 THEN '11–50' WHEN n <= 200 THEN '51–200' WHEN n <= 1000 THEN '201–1000' ELSE '1000+' END AS tier FROM i)
SELECT tier, count(*) AS items, ROUND(avg(m), 6) AS mean_item_rating, ROUND(median(m), 6) AS median_item_rating, ROUND(avg(n), 6) AS avg_reviews_per_item FROM t GROUP BY tier
""")
def rating_bias(spark, d):
    out = P.rating_bias_by_volume(interactions(spark, d), "item_id", "rating")
    return rounded(out, "mean_item_rating", "median_item_rating", "avg_reviews_per_item")


@query("d20_user_tiers", """
, u AS (SELECT user_id, count(*) AS n, avg(rating) AS m FROM interactions GROUP BY user_id)
SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2–5' WHEN n <= 20 THEN '6–20' WHEN n <= 100 THEN '21–100' ELSE '100+' END AS tier, count(*) AS users,
       ROUND(avg(n), 6) AS avg_reviews_per_user, ROUND(avg(m), 6) AS avg_user_rating FROM u GROUP BY 1
""")
def user_tiers(spark, d):
    out = P.user_tiers(interactions(spark, d), "user_id", "rating", S.USER_TIERS)
    return rounded(out, "avg_reviews_per_user", "avg_user_rating")


@query("d21_top_items", """
SELECT item_id, min(title) AS title, min(brand) AS brand, min(genre) AS genre, count(*) AS n_reviews, ROUND(avg(rating), 6) AS avg_rating
FROM interactions GROUP BY item_id ORDER BY n_reviews DESC, item_id LIMIT 100
""")
def top_items(spark, d):
    return rounded(P.top_items(interactions(spark, d), "item_id", ["title", "brand", "genre"], "rating"), "avg_rating")


@query("d22_popular_items", """
SELECT item_id, count(*) AS n_reviews, ROUND(avg(rating), 6) AS avg_rating, ROUND(stddev_samp(rating), 6) AS rating_std
FROM interactions GROUP BY item_id HAVING count(*) >= 20 ORDER BY n_reviews DESC, item_id LIMIT 5000
""")
def popular_items(spark, d):
    return rounded(P.popular_items(interactions(spark, d), "item_id", "rating", 20, n=5000), "avg_rating", "rating_std")


@query("d23_popularity_correlation", """
, i AS (SELECT item_id, count(*) AS n, avg(rating) AS m FROM interactions GROUP BY item_id HAVING count(*) >= 20)
SELECT ROUND(corr(n, m), 6) AS r, count(*) AS items FROM i
""")
def popularity_correlation(spark, d):
    items = P.popular_items(interactions(spark, d), "item_id", "rating", 20)
    return items.agg(rnd(F.corr("n_reviews", "avg_rating")).alias("r"), F.count(F.lit(1)).alias("items"))


@query("d23_popularity_quartiles", """
, i AS (SELECT item_id, count(*) AS n, avg(rating) AS m FROM interactions GROUP BY item_id HAVING count(*) >= 20),
q AS (SELECT quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.5) AS b, quantile_cont(n, 0.75) AS c FROM i)
SELECT CASE WHEN n <= a THEN 'Q1 (least)' WHEN n <= b THEN 'Q2' WHEN n <= c THEN 'Q3' ELSE 'Q4 (most)' END AS tier,
       ROUND(avg(m), 6) AS mean, ROUND(stddev_samp(m), 6) AS std, count(*) AS n FROM i, q GROUP BY 1
""")
def popularity_quartiles(spark, d):
    items = P.popular_items(interactions(spark, d), "item_id", "rating", 20)
    tiered = S.quantile_bucket(items, "n_reviews", ["Q1 (least)", "Q2", "Q3", "Q4 (most)"], "tier")
    return rounded(P.mean_and_std(tiered, "avg_rating", ["tier"]), "mean", "std")


@query("d24_power_users", """
, u AS (SELECT user_id, count(*) AS n FROM interactions GROUP BY user_id), q AS (SELECT quantile_cont(n, 0.99) AS t FROM u)
SELECT ROUND(max(t), 6) AS threshold, ROUND(sum(CASE WHEN n >= t THEN n ELSE 0 END) * 100.0 / sum(n), 6) AS pct_of_reviews,
       ROUND(count(*) FILTER (WHERE n = 1) * 100.0 / count(*), 6) AS pct_one_review_users FROM u, q
""")
def power_users(spark, d):
    return rounded(P.power_user_share(interactions(spark, d), "user_id"), "threshold", "pct_of_reviews", "pct_one_review_users")


_LENGTH = """
, w AS (SELECT *, length(review_text) AS c, CAST(len(string_split(trim(regexp_replace(review_text, '\\s+', ' ', 'g')), ' ')) AS INT) AS k, year(ts)::INT AS yr
        FROM reviews WHERE length(trim(review_text)) > 0)
SELECT {key}, count(*) AS reviews, ROUND(median(c), 6) AS median_chars, ROUND(avg(c), 6) AS mean_chars, ROUND(quantile_cont(c, 0.9), 6) AS p90_chars,
       ROUND(median(k), 6) AS median_words, ROUND(avg(k), 6) AS mean_words, ROUND(quantile_cont(k, 0.9), 6) AS p90_words FROM w GROUP BY 1
"""


def _lengths(spark, d, key):
    rows = reviews(spark, d).filter(F.length(F.trim("review_text")) > 0).select(
        "rating", F.year("ts").alias("yr"), F.length("review_text").alias("c"), word_count("review_text").alias("k")
    )
    out = P.length_by(rows, [key], "c", "k")
    return rounded(out, *[f"{s}_{v}" for s in ("median", "mean", "p90") for v in ("chars", "words")])


@query("d25_length_by_rating", _LENGTH.format(key="rating"), "reviews")
def length_by_rating(spark, d):
    return _lengths(spark, d, "rating")


@query("d25_length_by_year", _LENGTH.format(key="yr"), "reviews")
def length_by_year(spark, d):
    return _lengths(spark, d, "yr")


@query("d26_duplicate_pairs", "SELECT user_id, item_id, count(*) AS n FROM interactions GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_pairs(spark, d):
    return P.duplicate_pairs(interactions(spark, d), "user_id", "item_id")


@query("d29_sparsity_metrics", """
, i AS (SELECT brand, item_id, count(*) AS x FROM interactions GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY x, item_id) AS k FROM i),
g AS (SELECT brand, 2 * sum(k * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*) AS gini FROM r GROUP BY brand),
u AS (SELECT brand, user_id, count(*) AS n FROM interactions GROUP BY 1, 2), c AS (SELECT brand, avg(CASE WHEN n < 5 THEN 1.0 ELSE 0 END) AS cold_ratio FROM u GROUP BY brand),
b AS (SELECT brand, count(*) AS n_reviews, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items FROM interactions GROUP BY brand)
SELECT brand, n_reviews, n_users, n_items, ROUND(n_reviews / (n_users * n_items), 8) AS density, ROUND(gini, 6) AS gini, ROUND(cold_ratio, 6) AS cold_ratio FROM b JOIN g USING (brand) JOIN c USING (brand)
""")
def sparsity_metrics(spark, d):
    out = P.sparsity_metrics(interactions(spark, d), "brand", "user_id", "item_id")
    return rounded(rounded(out, "gini", "cold_ratio"), "density", digits=8)


@query("d30_sparsity_flags", """
, i AS (SELECT brand, item_id, count(*) AS x FROM interactions GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY x, item_id) AS k FROM i),
g AS (SELECT brand, 2 * sum(k * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*) AS gini FROM r GROUP BY brand),
u AS (SELECT brand, user_id, count(*) AS n FROM interactions GROUP BY 1, 2), c AS (SELECT brand, avg(CASE WHEN n < 5 THEN 1.0 ELSE 0 END) AS cold_ratio FROM u GROUP BY brand),
b AS (SELECT brand, count(*) / (count(DISTINCT user_id) * count(DISTINCT item_id)) AS density FROM interactions GROUP BY brand)
SELECT brand, COALESCE(NULLIF((CASE WHEN density < .026 THEN 'A' ELSE '' END) || (CASE WHEN gini > .10 THEN 'B' ELSE '' END) || (CASE WHEN cold_ratio > .958 THEN 'C' ELSE '' END), ''), 'none') AS type_flag
FROM b JOIN g USING (brand) JOIN c USING (brand)
""")
def sparsity_flags(spark, d):
    metrics = P.sparsity_metrics(interactions(spark, d), "brand", "user_id", "item_id")
    return P.sparsity_flags(metrics, 0.026, 0.10, 0.958).select("brand", "type_flag")


@query("d31_length_cdf", """
, l AS (SELECT length(review_text)::INT AS v, count(*) AS n FROM reviews GROUP BY 1)
SELECT v AS review_length, n, ROUND(sum(n) OVER (ORDER BY v) / sum(n) OVER (), 6) AS cdf, ROUND(sum(n) OVER (ORDER BY v DESC) / sum(n) OVER (), 6) AS ccdf FROM l
""", "reviews")
def length_cdf(spark, d):
    out = P.empirical_cdf(reviews(spark, d).select(F.length("review_text").alias("review_length")), "review_length")
    return rounded(out, "cdf", "ccdf")


@query("d31_user_ccdf", """
, u AS (SELECT user_id, count(*) AS n_reviews FROM interactions GROUP BY 1), l AS (SELECT n_reviews, count(*) AS n_entities FROM u GROUP BY 1)
SELECT n_reviews, n_entities, ROUND(sum(n_entities) OVER (ORDER BY n_reviews) / sum(n_entities) OVER (), 6) AS cdf,
       ROUND(sum(n_entities) OVER (ORDER BY n_reviews DESC) / sum(n_entities) OVER (), 6) AS ccdf FROM l
""")
def user_ccdf(spark, d):
    dist = P.count_distribution(interactions(spark, d), "user_id")
    return rounded(P.cdf_of(dist, "n_reviews", "n_entities"), "cdf", "ccdf")


@query("d32_stage_histogram", "SELECT stage, count(*) AS n FROM stages GROUP BY stage", "stages")
def stage_histogram(spark, d):
    return stages(spark, d).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("d33_quality_profile", """
, r AS (SELECT *, length(title) AS l FROM interactions)
SELECT count(*) AS reviews, count(*) FILTER (WHERE rating = 1) AS star_1, count(*) FILTER (WHERE rating = 2) AS star_2, count(*) FILTER (WHERE rating = 3) AS star_3,
       count(*) FILTER (WHERE rating = 4) AS star_4, count(*) FILTER (WHERE rating = 5) AS star_5, ROUND(quantile_cont(l, 0.25), 6) AS len_p25, ROUND(quantile_cont(l, 0.5), 6) AS len_p50,
       ROUND(quantile_cont(l, 0.75), 6) AS len_p75, ROUND(quantile_cont(l, 0.99), 6) AS len_p99, max(l)::INT AS len_max, count(*) FILTER (WHERE total_votes >= 5) AS n_voted,
       ROUND(avg(helpful_votes / total_votes) FILTER (WHERE total_votes >= 5), 6) AS helpful_ratio, count(*) FILTER (WHERE title IS NULL) AS null_body,
       count(*) FILTER (WHERE trim(title) = '') AS empty_body, ROUND(avg(verified), 6) AS verified_share FROM r
""")
def quality_profile(spark, d):
    out = P.quality_profile(interactions(spark, d), "rating", "title", "helpful_votes", "total_votes", "verified")
    return rounded(out, "len_p25", "len_p50", "len_p75", "len_p99", "helpful_ratio", "verified_share")


@query("d34_user_stats", """
SELECT user_id, count(*) AS user_review_count, count(DISTINCT genre) AS user_genre_count, count(DISTINCT genre) >= 6 AS is_bridge_user,
       count(*) FILTER (WHERE year(ts) < 1997) >= 10 AS is_valid_user FROM interactions GROUP BY user_id
""")
def user_stats(spark, d):
    return P.user_stats(interactions(spark, d), "user_id", "genre", "ts", 6, 10, 1997)


@query("d35_means_and_stds", """
SELECT 'user' AS kind, user_id AS id, ROUND(avg(rating), 6) AS mean, ROUND(stddev_samp(rating), 6) AS std, count(*) AS n FROM interactions GROUP BY user_id
UNION ALL SELECT 'item', item_id, ROUND(avg(rating), 6), ROUND(stddev_samp(rating), 6), count(*) FROM interactions GROUP BY item_id
UNION ALL SELECT 'all', NULL, ROUND(avg(rating), 6), ROUND(stddev_samp(rating), 6), count(*) FROM interactions
""")
def means_and_stds(spark, d):
    rows = interactions(spark, d)
    users = P.mean_and_std(rows, "rating", ["user_id"]).withColumnRenamed("user_id", "id").withColumn("kind", F.lit("user"))
    items = P.mean_and_std(rows, "rating", ["item_id"]).withColumnRenamed("item_id", "id").withColumn("kind", F.lit("item"))
    overall = P.mean_and_std(rows, "rating", []).withColumn("id", F.lit(None).cast("bigint")).withColumn("kind", F.lit("all"))
    return rounded(users.unionByName(items).unionByName(overall), "mean", "std").select("kind", "id", "mean", "std", "n")


@query("d36_histogram", """
SELECT least(floor((n_tokens - 1) / 4.9) + 1, 10)::BIGINT AS bucket, count(*) AS n FROM interactions WHERE n_tokens BETWEEN 1 AND 50 GROUP BY 1
""")
def histogram(spark, d):
    return P.equal_width_histogram(interactions(spark, d), "n_tokens", 1, 50, 10)


@query("d36_box_numbers", """
SELECT rating, min(n_chars) AS min_value, ROUND(quantile_cont(n_chars, 0.25), 6) AS q1, ROUND(median(n_chars), 6) AS median, ROUND(quantile_cont(n_chars, 0.75), 6) AS q3,
       max(n_chars) AS max_value, ROUND(avg(n_chars), 6) AS mean_value FROM reviews GROUP BY rating
""", "reviews")
def box_numbers(spark, d):
    return rounded(P.box_numbers(reviews(spark, d), ["rating"], "n_chars"), "q1", "median", "q3", "mean_value")


@query("d36_rating_length_grid", """
SELECT rating, least(floor(n_chars / 500.0) + 1, 20)::BIGINT AS bucket, count(*) AS n FROM reviews WHERE n_chars >= 0 GROUP BY 1, 2
""", "reviews")
def rating_length_grid(spark, d):
    return P.equal_width_histogram(reviews(spark, d), "n_chars", 0, 10000, 20, ["rating"], open_end=True)
