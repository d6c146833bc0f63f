"""I: features and matrices."""

from pyspark.sql import functions as F

from prefmine.core import rnd, stored
from prefmine.datasets import KEY, interactions, reviews, table
from prefmine.models import linalg as L
from prefmine.operators import features as X
from prefmine.queries.profiles import rounded
from prefmine.queries.registry import query

ITEM_ORDER = ["ts", "user_id", "order_key", "line_no", "n_tokens"]

_TEXT = ", txt AS (SELECT item_id, string_agg(review_text, ' ' ORDER BY ts, review_id) AS t FROM reviews GROUP BY item_id)"
_TFIDF = """
, n AS (SELECT count(*) AS n FROM (SELECT DISTINCT item_id FROM src)), tf AS (SELECT item_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
v AS (SELECT term, count(*) AS df FROM tf, n GROUP BY term, n HAVING count(*) >= {mn} AND count(*) <= {mx} * n ORDER BY sum(tf) DESC, term LIMIT {k}),
w AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM tf JOIN v USING (term), n)
SELECT item_id, term AS feature, ROUND(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS value FROM w
"""


@query("d27_item_texts", """
, r AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY ts, review_id) - 1) // 8 AS part FROM reviews WHERE review_text IS NOT NULL)
SELECT item_id, CAST(part AS INT) AS part, md5(string_agg(review_text, ' ' ORDER BY ts, review_id)) AS text FROM r GROUP BY 1, 2
""", "reviews")
def item_texts(spark, d):
    out = X.item_texts(reviews(spark, d), "item_id", F.to_date("ts"), ["ts", "review_id"], "review_text", 8)
    return out.withColumn("text", F.md5("text"))


@query("d28_item_attributes", """
SELECT item_id, ROUND(avg(rating), 6) AS avg_rating, count(*) AS n_reviews, arg_min(price, (ts, user_id, order_key, line_no, n_tokens)) AS price,
       arg_min(brand, (ts, user_id, order_key, line_no, n_tokens)) AS brand FROM interactions GROUP BY item_id
""")
def item_attributes(spark, d):
    return rounded(X.item_attributes(interactions(spark, d), "item_id", "rating", "price", "brand", ITEM_ORDER), "avg_rating")


@query("i01_review_tfidf", _TEXT + """
, src AS (SELECT DISTINCT item_id FROM reviews), tok AS (SELECT item_id, regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]{2,}') AS k FROM txt),
terms AS (SELECT item_id, unnest(k) AS term FROM tok UNION ALL SELECT item_id, unnest(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) FROM tok)
""" + _TFIDF.format(mn=5, mx=0.95, k=3000), "reviews")
def review_tfidf(spark, d):
    rows = reviews(spark, d)
    counts = X.term_rows(rows, "item_id", "review_text", True, ["ts", "review_id"], F.to_date("ts"))
    n = rows.agg(F.countDistinct("item_id")).scalar()
    return rounded(X.tf_idf(counts, "item_id", n, 5, 0.95, 3000), "value")


@query("i02_meta_tfidf", """
WITH src AS (SELECT p_partkey AS item_id FROM part), terms AS (SELECT p_partkey AS item_id, unnest(regexp_extract_all(lower(trim(p_name || ' ' || p_type)), '[\\p{L}\\p{N}_]{2,}')) AS term FROM part)
""" + _TFIDF.format(mn=3, mx=1.0, k=1000), "")
def meta_tfidf(spark, d):
    items = table(spark, d, "part").withColumnRenamed("p_partkey", "item_id")
    meta = X.first_meta(items, "item_id", ["item_id"], ["p_name", "p_type"])
    n = items.agg(F.countDistinct("item_id")).scalar()
    return rounded(X.tf_idf(X.term_rows(meta, "item_id", "meta_text", False), "item_id", n, 3, 1.0, 1000), "value")


_ATTR = ", a AS (SELECT item_id, avg(rating) AS r, count(*) AS n, CASE WHEN min(n_tokens) = 2 THEN NULL ELSE min(price) END AS p, min(brand) AS brand FROM interactions GROUP BY item_id)"


def _attributes(spark, d):
    a = X.item_attributes(interactions(spark, d), "item_id", "rating", "price", "brand", ITEM_ORDER, F.min("n_tokens").alias("low"))
    return a.filter("item_id IS NOT NULL").withColumn("price", F.when(F.col("low") != 2, F.col("price")))


@query("i03_numeric_features", _ATTR + """
, b AS (SELECT item_id, COALESCE(p, (SELECT median(p) FROM a)) AS p, r, n FROM a)
SELECT item_id, ROUND(p / (SELECT avg(p) FROM b), 6) AS price_scaled, ROUND(r / (SELECT avg(r) FROM b), 6) AS rating_scaled, ROUND(ln(1 + n), 6) AS log_count FROM b
""")
def numeric_features(spark, d):
    return rounded(X.numeric_features(_attributes(spark, d), "item_id"), "price_scaled", "rating_scaled", "log_count")


@query("i04_brand_features", _ATTR + """
, t AS (SELECT brand FROM a GROUP BY brand ORDER BY count(*) DESC, brand LIMIT 10)
SELECT item_id, 'brand_' || CASE WHEN brand IN (SELECT brand FROM t) THEN brand ELSE 'other' END AS feature, 1.0::DOUBLE AS value FROM a
""")
def brand_features(spark, d):
    return X.brand_features(_attributes(spark, d), "item_id", 10)


def all_features(spark, d):
    """Text, metadata, numeric and brand features of the reviewed items."""
    rows = reviews(spark, d)
    n = rows.agg(F.countDistinct("item_id")).scalar()
    text = X.tf_idf(X.term_rows(rows, "item_id", "review_text", True, ["ts", "review_id"], F.to_date("ts")), "item_id", n, 5, 0.95, 3000)
    ids = rows.select("item_id").distinct()
    attributes = stored(_attributes(spark, d).join(ids, "item_id", "left_semi"), "attributes")
    numeric = X.melt(X.numeric_features(attributes, "item_id"), "item_id", ["price_scaled", "rating_scaled", "log_count"])
    return X.stack_features({"text": text, "num": numeric, "brand": X.brand_features(attributes, "item_id", 10)}, "item_id")


@query("i05_stacked_features")
def stacked_features(spark, d):
    out = all_features(spark, d).groupBy(F.split("feature", ":")[0].alias("block")).agg(
        F.count(F.lit(1)).alias("cells"), F.countDistinct("feature").alias("features"), rnd(F.sum("value"), 4).alias("total")
    )
    return out


@query("i06_truncated_svd")
def truncated_svd(spark, d):
    from prefmine.core import cut_lineage

    rows, _, singular, share, _ = L.truncated_svd(cut_lineage(all_features(spark, d)), "item_id", "feature", "value", 8, rounds=30, tol=0.01)
    return rows.select("item_id", L.unit(F.col("vec")).alias("vec"), F.lit(share).alias("explained"), F.lit(float(singular[0])).alias("largest"))


@query("i07_double_centred", """
, m AS (SELECT user_id, item_id, CAST(sum(rating) AS DOUBLE) AS v FROM interactions GROUP BY 1, 2), u AS (SELECT *, v - avg(v) OVER (PARTITION BY user_id) AS c FROM m)
SELECT user_id, item_id, v AS value, ROUND(c - avg(c) OVER (PARTITION BY item_id), 6) + 0.0 AS centred FROM u
""")
def double_centred(spark, d):
    out = X.double_centred(X.utility_matrix(interactions(spark, d), "user_id", "item_id", "rating"), "user_id", "item_id")
    return rounded(out.select("user_id", "item_id", "value", "centred"), "centred")


@query("i08_implicit_matrix", "SELECT user_id, item_id, CAST(count(*) AS DOUBLE) AS value FROM interactions GROUP BY 1, 2")
def implicit_matrix(spark, d):
    return X.implicit_matrix(interactions(spark, d), "user_id", "item_id")


VEC = ", e AS (SELECT vec_id AS item_id, unnest(range(0, 64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vec"))


def long(df, key):
    return df.select(key, F.posexplode("vec").alias("pos", "x")).withColumn("pos", F.col("pos").cast("bigint")).withColumn("x", rnd("x", 5))


@query("i09_decayed_profile", VEC + """
, m AS (SELECT user_id, avg(v) AS mean FROM (SELECT user_id, item_id, sum(rating) AS v FROM interactions GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT user_id, pos, sum((rating - mean) * exp(-0.001 * date_sub('day', ts, (SELECT max(ts) FROM interactions))) * x) AS x FROM interactions JOIN m USING (user_id) JOIN e USING (item_id) GROUP BY 1, 2)
SELECT user_id, pos, ROUND(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY user_id)), 1e-12), 5) + 0.0 AS x FROM s
""")
def decayed_profile(spark, d):
    return long(X.decayed_profile(interactions(spark, d), vectors(spark, d), "user_id", "item_id", "rating", "ts", 64), "user_id")


@query("i10_mean_profile", VEC + """
, s AS (SELECT user_id, pos, sum(x) AS x FROM interactions JOIN e USING (item_id) GROUP BY 1, 2)
SELECT user_id, pos, ROUND(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY user_id)), 1e-12), 5) + 0.0 AS x FROM s
""")
def mean_profile(spark, d):
    return long(X.mean_profile(interactions(spark, d), vectors(spark, d), "user_id", "item_id", 64), "user_id")


@query("i11_unit_vectors", "WITH " + VEC[2:] + """
SELECT item_id, pos, ROUND(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY item_id)), 1e-12), 5) + 0.0 AS x FROM e
""", "")
def unit_vectors(spark, d):
    return long(vectors(spark, d).withColumn("vec", L.unit(F.col("vec"))), "item_id")


@query("i12_min_max", """
, i AS (SELECT item_id, count(*) AS n, avg(rating) AS m FROM interactions GROUP BY item_id)
SELECT item_id, ROUND((n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()), 6) AS n_scaled, ROUND((m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ()), 6) AS m_scaled FROM i
""")
def min_max(spark, d):
    items = interactions(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("m"))
    return rounded(X.min_max(items, ["n", "m"]), "n_scaled", "m_scaled").select("item_id", "n_scaled", "m_scaled")


PREDS_SQL = "SELECT order_key, line_no, item_id, n_tokens, rating, 2.0 + n_tokens % 7 / 3.1 AS base, 1.0 + n_tokens % 11 / 3.3 AS a, 1.5 + total_votes / 4.3 AS b, 1.0 + helpful_votes / 2.3 AS c, 3.0 + verified / 1.7 AS d FROM interactions"


def predictions(spark, d):
    """Five prediction-like columns computed from the interactions, for the blending operators."""
    c = F.col
    return interactions(spark, d).select(
        *KEY, "rating", (2.0 + c("n_tokens") % 7 / 3.1).alias("base"), (1.0 + c("n_tokens") % 11 / 3.3).alias("a"), (1.5 + c("total_votes") / 4.3).alias("b"),
        (1.0 + c("helpful_votes") / 2.3).alias("c"), (3.0 + c("verified") / 1.7).alias("d"),
    )


META_SQL = f", z AS ({PREDS_SQL})" + """, meta AS (SELECT *, b - base AS b_minus_base, c - base AS c_minus_base, d - base AS d_minus_base, a - base AS a_minus_base, abs(b - base) AS abs_b_minus_base, abs(c - base) AS abs_c_minus_base,
 abs(d - base) AS abs_d_minus_base, abs(a - base) AS abs_a_minus_base, (a + b + c + d) / 4 AS prediction_mean,
 sqrt((power(a - (a+b+c+d)/4, 2) + power(b - (a+b+c+d)/4, 2) + power(c - (a+b+c+d)/4, 2) + power(d - (a+b+c+d)/4, 2)) / 4) AS prediction_std, greatest(a, b, c, d) - least(a, b, c, d) AS prediction_range FROM z)"""


@query("i13_residual_meta", META_SQL + " SELECT order_key, line_no, item_id, n_tokens, " + ", ".join(f"ROUND({c}, 5) + 0.0 AS {c}" for c in X.META_FEATURES) + " FROM meta")
def residual_meta(spark, d):
    out = X.residual_meta(predictions(spark, d))
    return rounded(out.select(*KEY, *X.META_FEATURES), *X.META_FEATURES, digits=5)
