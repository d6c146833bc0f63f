"""B: projection, predicates and scalar functions."""

from pyspark.sql import functions as F

from prefmine.core import exact_quantiles, rnd, value_percentiles
from prefmine.datasets import interactions, reviews, table
from prefmine.functions import scalars as S
from prefmine.functions import text as T
from prefmine.queries.registry import query


@query("b01_gated_dates", """
SELECT review_id, TRY_CAST(CASE WHEN regexp_full_match(txt, '\\d{4}-\\d{2}-\\d{2}') THEN txt END AS DATE) AS review_date,
       TRY_CAST(votes AS INT) AS votes
FROM (SELECT review_id, CASE WHEN rating = 1 THEN strftime(ts, '%d/%m/%Y') ELSE strftime(ts, '%Y-%m-%d') END AS txt,
             CASE WHEN rating = 2 THEN 'n/a' ELSE CAST(n_chars AS VARCHAR) END AS votes FROM reviews)
WHERE regexp_full_match(txt, '\\d{4}-\\d{2}-\\d{2}')
""", "reviews")
def gated_dates(spark, d):
    raw = reviews(spark, d).select(
        "review_id",
        F.when(F.col("rating") == 1, F.date_format("ts", "dd/MM/yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("txt"),
        F.when(F.col("rating") == 2, "n/a").otherwise(F.col("n_chars").cast("string")).alias("votes"),
    )
    return raw.filter(F.col("txt").rlike(r"^\d{4}-\d{2}-\d{2}$")).select(
        "review_id", S.iso_date("txt").alias("review_date"), S.to_number("votes", "int").alias("votes")
    )


@query("b02_validation_profile", """
SELECT count(*) AS total_rows, count(*) FILTER (WHERE l.review_id IS NULL) AS null_review_id,
       count(*) FILTER (WHERE item_id IS NULL) AS null_product_id, count(*) FILTER (WHERE rating IS NULL) AS null_star_rating,
       count(*) FILTER (WHERE review_text IS NULL) AS null_review_body, count(*) FILTER (WHERE rating < 2 OR rating > 4) AS invalid_rating,
       count(*) FILTER (WHERE n_chars > 2000) AS vote_inconsistency,
       count(*) FILTER (WHERE review_text = '' OR review_text IS NULL) AS empty_reviews,
       count(*) FILTER (WHERE length(review_text) < 10) AS short_reviews,
       CAST(min(ts) AS DATE) AS min_date, CAST(max(ts) AS DATE) AS max_date
FROM reviews l
""", "reviews")
def validation_profile(spark, d):
    from prefmine.operators.profiles import validation_profile as profile

    return profile(
        reviews(spark, d).withColumn("limit", F.lit(2000)), key="review_id", item="item_id", rating="rating", body="review_text",
        helpful="n_chars", total="limit", date="ts", low=2, high=4,
    )


@query("b03_flags", """
SELECT order_key, line_no, item_id, n_tokens, CAST(CASE WHEN verified = 1 THEN 1 ELSE 0 END AS INT) AS verified_purchase FROM interactions
""")
def flags(spark, d):
    raw = interactions(spark, d).withColumn("verified_purchase", F.when(F.col("verified") == 1, "Y").otherwise("N"))
    return raw.select("order_key", "line_no", "item_id", "n_tokens", S.flag("verified_purchase").alias("verified_purchase"))


@query("b04_category_whitelist", """
SELECT category, count(*) AS n FROM (SELECT *, CASE genre WHEN 'en' THEN 'Books' WHEN 'de' THEN 'Music' WHEN 'fr' THEN 'Software' ELSE 'Gift Card' END AS cat FROM reviews)
WHERE cat IN ('Books', 'Music') GROUP BY category
""", "reviews")
def category_whitelist(spark, d):
    cat = F.when(F.col("genre") == "en", "Books").when(F.col("genre") == "de", "Music").when(F.col("genre") == "fr", "Software").otherwise("Gift Card")
    rows = reviews(spark, d).withColumn("cat", cat).filter(F.col("cat").isin(S.KEPT_CATEGORIES))
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("b05_required_fields", """
SELECT doc_id, COALESCE(quality, 0) AS votes FROM documents LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL
""", "")
def required_fields(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rows.filter(F.col("text").isNotNull()).select("doc_id", F.coalesce("quality", F.lit(0)).alias("votes"))


@query("b06_helpful_ratio", """
SELECT order_key, line_no, item_id, n_tokens, ROUND(CASE WHEN total_votes > 0 THEN helpful_votes / total_votes ELSE 0 END, 6) AS helpful_ratio FROM interactions
""")
def helpful_ratio(spark, d):
    return interactions(spark, d).select(
        "order_key", "line_no", "item_id", "n_tokens", rnd(S.helpful_ratio("helpful_votes", "total_votes")).alias("helpful_ratio")
    )


@query("b07_text_length", "SELECT review_id, CAST(length(review_text) AS INT) AS review_length FROM reviews", "reviews")
def text_length(spark, d):
    return reviews(spark, d).select("review_id", F.length("review_text").alias("review_length"))


@query("b08_exact_dedup", """
SELECT order_key, line_no, item_id, n_tokens, user_id FROM interactions
QUALIFY row_number() OVER (PARTITION BY order_key, line_no ORDER BY item_id, n_tokens) = 1
""")
def exact_dedup(spark, d):
    from prefmine.operators.sets import first_per_key

    rows = interactions(spark, d).select("order_key", "line_no", "item_id", "n_tokens", "user_id")
    return first_per_key(rows, ["order_key", "line_no"], ["item_id", "n_tokens"])


@query("b09_any_date", """
SELECT review_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed FROM reviews WHERE rating <> 5
UNION ALL SELECT review_id, NULL FROM reviews WHERE rating = 5
""", "reviews")
def any_date(spark, d):
    ts = F.col("ts")
    form = (
        F.when(F.col("rating") == 1, F.concat(F.lit("Thu "), F.date_format(ts - F.expr("INTERVAL 8 HOURS"), "MMM dd HH:mm:ss"), F.lit(" -0800 "), F.date_format(ts - F.expr("INTERVAL 8 HOURS"), "yyyy")))
        .when(F.col("rating") == 2, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("+0000")))
        .when(F.col("rating") == 3, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("rating") == 4, F.date_format(ts, "yyyy-MM-dd"))
        .otherwise("not a date")
    )
    parsed = S.any_timestamp(form)
    return reviews(spark, d).select("review_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("b10_coerced_numbers", """
SELECT doc_id, COALESCE(TRY_CAST(CASE WHEN source = 'src1' THEN 'abc' ELSE CAST(n_chars AS VARCHAR) END AS DOUBLE), NULL) AS rating,
       COALESCE(TRY_CAST(CASE WHEN lang = 'en' THEN '' ELSE CAST(n_chars AS VARCHAR) END AS INT), 0) AS n_votes FROM documents
""", "")
def coerced_numbers(spark, d):
    docs = table(spark, d, "documents")
    rating = F.when(F.col("source") == "src1", "abc").otherwise(F.col("n_chars").cast("string"))
    votes = F.when(F.col("lang") == "en", "").otherwise(F.col("n_chars").cast("string"))
    return docs.select("doc_id", S.to_number(rating).alias("rating"), F.coalesce(S.to_number(votes, "int"), F.lit(0)).alias("n_votes"))


@query("b11_text_normalise", """
SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS clean FROM pages
""", "")
def text_normalise(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.strip_tags("html")).alias("clean"))


@query("b11_text_unescape", views="")
def text_unescape(spark, d):
    pages = T.normalise_text(table(spark, d, "pages"), "html", "clean")
    return pages.select("page_id", F.md5("clean").alias("clean"), F.length("clean").alias("n_chars"))


@query("b12_token_count", """
SELECT review_id, CAST(len(string_split(w, ' ')) AS INT) AS n_tokens FROM
  (SELECT review_id, trim(regexp_replace(review_text, '\\s+', ' ', 'g')) AS w FROM reviews)
WHERE w <> '' AND len(string_split(w, ' ')) >= 10
""", "reviews")
def token_count(spark, d):
    return reviews(spark, d).select("review_id", T.word_count("review_text").alias("n_tokens")).filter(F.col("n_tokens") >= 10)


@query("b13_admission", """
SELECT review_id, rating FROM reviews WHERE rating > 0 AND review_text IS NOT NULL AND length(trim(review_text)) > 20
""", "reviews")
def admission(spark, d):
    from prefmine.operators.joins import admitted

    return admitted(reviews(spark, d), "rating", "review_text").select("review_id", "rating")


@query("b14_vote_weight", """
, c AS (SELECT genre, CASE WHEN quantile_cont(total_votes, 0.99) = 0 THEN 1.0 ELSE quantile_cont(total_votes, 0.99) END AS vote_cap FROM interactions GROUP BY genre)
SELECT order_key, line_no, item_id, n_tokens, ROUND(vote_cap, 6) AS vote_cap, ROUND(ln(1 + least(total_votes, vote_cap)), 6) AS vote_weight
FROM interactions JOIN c USING (genre)
""")
def vote_weight(spark, d):
    rows = S.vote_weight(interactions(spark, d), "genre", "total_votes")
    return rows.select("order_key", "line_no", "item_id", "n_tokens", rnd("vote_cap").alias("vote_cap"), rnd("vote_weight").alias("vote_weight"))


@query("b14_vote_weight_unclean", """
, v AS (SELECT *, CASE WHEN line_no % 3 = 0 THEN NULL WHEN line_no % 5 = 0 THEN -total_votes ELSE total_votes END AS votes FROM interactions),
u AS (SELECT *, greatest(coalesce(votes, 0), 0) AS counted FROM v),
c AS (SELECT genre, CASE WHEN quantile_cont(counted, 0.99) = 0 THEN 1.0 ELSE quantile_cont(counted, 0.99) END AS vote_cap FROM u GROUP BY genre)
SELECT order_key, line_no, item_id, n_tokens, votes, ROUND(vote_cap, 6) AS vote_cap, ROUND(ln(1 + least(counted, vote_cap)), 6) AS vote_weight
FROM u JOIN c USING (genre)
""")
def vote_weight_unclean(spark, d):
    votes = F.when(F.col("line_no") % 3 == 0, None).when(F.col("line_no") % 5 == 0, -F.col("total_votes")).otherwise(F.col("total_votes"))
    rows = S.vote_weight(interactions(spark, d).withColumn("votes", votes), "genre", "votes")
    return rows.select("order_key", "line_no", "item_id", "n_tokens", "votes", rnd("vote_cap").alias("vote_cap"), rnd("vote_weight").alias("vote_weight"))


@query("b15_edge_weights", """
SELECT order_key, line_no, item_id, n_tokens, ROUND(rating/5.0*ln(1+total_votes), 6) AS f1_rating_votes, ROUND(rating/5.0, 6) AS f2_rating_only,
       ROUND(rating/5.0*ln(1+n_tokens), 6) AS f3_rating_length, ROUND(rating/5.0*ln(1+total_votes)*ln(1+n_tokens), 6) AS f4_rating_votes_length,
       CASE WHEN rating >= 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f5_binary_positive FROM interactions
""")
def edge_weights(spark, d):
    formulas = S.edge_weights("rating", "total_votes", "n_tokens")
    return interactions(spark, d).select("order_key", "line_no", "item_id", "n_tokens", *[rnd(c).alias(n) for n, c in formulas.items()])


@query("b16_stabilised_weight", """
, w AS (SELECT *, greatest(rating/5.0*ln(1+total_votes)*ln(1+n_tokens), 0) AS x FROM interactions),
q AS (SELECT quantile_cont(x, 0.99) AS p FROM w), c AS (SELECT w.*, least(x, p) AS y FROM w, q)
SELECT order_key, line_no, item_id, n_tokens, ROUND(y / (SELECT max(y) FROM c), 6) AS edge_weight FROM c
""")
def stabilised_weight(spark, d):
    weighted = interactions(spark, d).select(
        "order_key", "line_no", "item_id", "n_tokens",
        S.edge_weights("rating", "total_votes", "n_tokens")["f4_rating_votes_length"].alias("edge_weight"),
    )
    out = S.stabilise(weighted, "edge_weight", exact_quantiles(weighted, "edge_weight", {"p99": 0.99}))
    return out.withColumn("edge_weight", rnd("edge_weight"))


@query("b17_numeric_clip", """
SELECT order_key, line_no, item_id, n_tokens, CAST(least(greatest(COALESCE(rating, 0), 0), 4) AS INT) AS rating,
       CAST(greatest(COALESCE(total_votes - 5, 0), 0) AS INT) AS votes FROM interactions
""")
def numeric_clip(spark, d):
    return interactions(spark, d).select(
        "order_key", "line_no", "item_id", "n_tokens", S.clip(F.coalesce("rating", F.lit(0)), 0, 4).alias("rating"),
        S.clip(F.coalesce(F.col("total_votes") - 5, F.lit(0)), 0).alias("votes"),
    )


@query("b18_length_outliers", """
, q AS (SELECT quantile_cont(length(review_text), 0.99) AS p99 FROM reviews)
SELECT review_id, length(review_text)::INT AS review_length FROM reviews, q
WHERE user_id IN (SELECT user_id FROM reviews GROUP BY user_id HAVING count(*) >= 2)
  AND length(review_text) BETWEEN 10 AND p99
""", "reviews")
def length_outliers(spark, d):
    rows = reviews(spark, d).withColumn("review_length", F.length("review_text"))
    cap = value_percentiles(rows, [], "review_length", {"p99": 0.99}).scalar()
    active = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    kept = rows.join(active, "user_id", "left_semi")
    return kept.filter((F.col("review_length") >= 10) & (F.col("review_length") <= cap)).select("review_id", "review_length")


@query("b19_calendar_split_closed", """
SELECT order_key, line_no, item_id, n_tokens, CASE year(ts) WHEN 1999 THEN 'val' WHEN 2000 THEN 'test' ELSE 'train' END AS split FROM interactions
""")
def calendar_split_closed(spark, d):
    return interactions(spark, d).select("order_key", "line_no", "item_id", "n_tokens", S.calendar_split("ts", (1999,), 2000, 2000).alias("split"))


@query("b20_calendar_split_open", """
SELECT order_key, line_no, item_id, n_tokens, CASE WHEN year(ts) = 1999 THEN 'val' WHEN year(ts) >= 2000 THEN 'test' ELSE 'train' END AS split FROM interactions
""")
def calendar_split_open(spark, d):
    return interactions(spark, d).select("order_key", "line_no", "item_id", "n_tokens", S.calendar_split("ts", (1999,), 2000, None).alias("split"))


@query("b21_activity_buckets", """
, u AS (SELECT user_id, count(*) AS n FROM interactions GROUP BY user_id)
SELECT user_id, n, CASE WHEN n <= 1 THEN 'new (0-1)' WHEN n <= 4 THEN 'cold (2-4)' WHEN n <= 19 THEN 'medium (5-19)' ELSE 'warm (>=20)' END AS bucket,
       CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2–5' WHEN n <= 20 THEN '6–20' WHEN n <= 100 THEN '21–100' ELSE '100+' END AS tier,
       CASE WHEN n <= 10 THEN '1–10' WHEN n <= 50 THEN '11–50' WHEN n <= 200 THEN '51–200' WHEN n <= 1000 THEN '201–1000' ELSE '1000+' END AS volume FROM u
""")
def activity_buckets(spark, d):
    counts = interactions(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "user_id", "n", S.bucket_label("n", S.ACTIVITY_BUCKETS).alias("bucket"), S.bucket_label("n", S.USER_TIERS).alias("tier"),
        S.bucket_label("n", S.VOLUME_TIERS).alias("volume"),
    )


@query("b22_count_groups", """
, u AS (SELECT user_id, count(*) AS un FROM reviews GROUP BY user_id), i AS (SELECT item_id, count(*) AS n FROM reviews GROUP BY item_id)
SELECT review_id, (CASE WHEN un <= 2 THEN 'low' WHEN un <= 10 THEN 'mid' ELSE 'high' END) || '_' ||
       (CASE WHEN n <= 2 THEN 'low' WHEN n <= 20 THEN 'mid' ELSE 'high' END) AS user_group
FROM reviews JOIN u USING (user_id) JOIN i USING (item_id)
""", "reviews")
def count_groups(spark, d):
    from prefmine.operators.joins import attach_counts

    rows = attach_counts(attach_counts(reviews(spark, d), ["user_id"], "un"), ["item_id"], "n")
    return rows.select("review_id", S.count_group("un", "n").alias("user_group"))


@query("b23_quantile_buckets", """
, i AS (SELECT item_id, count(*) AS n FROM interactions GROUP BY item_id),
q AS (SELECT quantile_cont(n, 0.25) AS a, quantile_cont(n, 0.5) AS b, quantile_cont(n, 0.75) AS c FROM i)
SELECT item_id, n, CASE WHEN n <= a THEN 'Q1 (least)' WHEN n <= b THEN 'Q2' WHEN n <= c THEN 'Q3' ELSE 'Q4 (most)' END AS tier FROM i, q
""")
def quantile_buckets(spark, d):
    counts = interactions(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return S.quantile_bucket(counts, "n", ["Q1 (least)", "Q2", "Q3", "Q4 (most)"], "tier")


@query("b24_log_histogram", """
, u AS (SELECT user_id, count(*) AS n FROM interactions GROUP BY user_id), m AS (SELECT max(n) AS m FROM u),
e AS (SELECT DISTINCT CASE WHEN i = 39 THEN m ELSE CAST(floor(power(10, log10(m) * i / 39)) AS BIGINT) END AS e FROM m, range(40) t(i)),
s AS (SELECT e AS low, lead(e) OVER (ORDER BY e) AS high, row_number() OVER (ORDER BY e DESC) AS back FROM e)
SELECT low, high, ROUND(sqrt(low * high), 6) AS center,
       (SELECT count(*) FROM u WHERE n >= low AND (n < high OR (back = 2 AND n = high))) AS n FROM s WHERE high IS NOT NULL
""")
def log_histogram(spark, d):
    counts = interactions(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("reviews"))
    out = S.log_histogram(counts, "reviews")
    return out.select("low", "high", rnd("center").alias("center"), "n")


@query("b25_slugs", """
SELECT item_id, replace(replace(genre || ', ' || brand, ', ', '_'), ' ', '_') AS label, replace(replace(title || ', x', ', ', '_'), ' ', '-') AS dashed,
       replace(replace(title || '/a', ' ', '_'), '/', '_') AS file
FROM (SELECT DISTINCT item_id, genre, brand, title FROM interactions)
""")
def slugs(spark, d):
    items = interactions(spark, d).select("item_id", "genre", "brand", "title").distinct()
    return items.select(
        "item_id", S.slug(F.concat_ws(", ", "genre", "brand")).alias("label"),
        S.slug(F.concat(F.col("title"), F.lit(", x")), "-").alias("dashed"), S.file_slug(F.concat(F.col("title"), F.lit("/a"))).alias("file"),
    )


@query("b26_top_values", """
, b AS (SELECT *, CASE WHEN brand = 'Brand#11' THEN NULL ELSE brand END AS bn FROM interactions),
t AS (SELECT bn FROM b WHERE bn IS NOT NULL GROUP BY bn ORDER BY count(*) DESC, bn LIMIT 5)
SELECT CASE WHEN bn IN (SELECT bn FROM t) THEN bn ELSE 'other' END AS brand_clean, count(*) AS n FROM b GROUP BY 1
""")
def top_values(spark, d):
    rows = interactions(spark, d).withColumn("bn", F.when(F.col("brand") != "Brand#11", F.col("brand")))
    return S.collapse_rare(rows, "bn", 5, "brand_clean").groupBy("brand_clean").agg(F.count(F.lit(1)).alias("n"))


@query("b27_null_profile", """
, t AS (SELECT doc_id, text, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)), n AS (SELECT count(*) AS total_rows FROM t)
SELECT column_name, total_rows, null_rows, empty_string_rows, ROUND(null_rows / total_rows * 100, 6) AS null_pct, ROUND(empty_string_rows / total_rows * 100, 6) AS empty_string_pct
FROM n, (SELECT 'doc_id' AS column_name, count(*) FILTER (WHERE doc_id IS NULL) AS null_rows, count(*) FILTER (WHERE CAST(doc_id AS VARCHAR) = '') AS empty_string_rows FROM t
 UNION ALL SELECT 'text', count(*) FILTER (WHERE text IS NULL), count(*) FILTER (WHERE text = '') FROM t
 UNION ALL SELECT 'quality', count(*) FILTER (WHERE quality IS NULL), count(*) FILTER (WHERE CAST(quality AS VARCHAR) = '') FROM t)
""".replace(", t AS", "WITH t AS", 1), "")
def null_profile(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    out = S.null_profile(rows, ["doc_id", "text", "quality"])
    return out.withColumn("null_pct", rnd("null_pct")).withColumn("empty_string_pct", rnd("empty_string_pct"))


@query("b28_rating_clip", """
SELECT order_key, line_no, item_id, n_tokens, CAST(least(greatest(n_tokens / 8.0, 1.0), 5.0) AS DOUBLE) AS rating FROM interactions
""")
def rating_clip(spark, d):
    return interactions(spark, d).select("order_key", "line_no", "item_id", "n_tokens", S.clip(F.col("n_tokens") / 8.0, 1.0, 5.0).alias("rating"))
