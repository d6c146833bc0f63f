"""M: text, topics and taste."""

from pyspark.sql import functions as F

from prefmine.core import rnd, stored
from prefmine.datasets import interactions, reviews, table
from prefmine.functions import scalars as S
from prefmine.operators import profiles as P
from prefmine.plans import taste as T
from prefmine.queries.profiles import rounded
from prefmine.queries.registry import query

STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
TOK = f""", tk AS (SELECT review_id, item_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(review_text), '[^a-zA-Z\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '),
 lambda t: length(t) > 2 AND t NOT IN ({STOPS})) AS k FROM reviews), doc AS (SELECT * FROM tk WHERE len(k) >= 5)"""


@query("m01_topic_tokens", TOK + " SELECT review_id, len(k)::INT AS n_tokens, md5(array_to_string(k, ' ')) AS tokens FROM doc", "reviews")
def topic_tokens(spark, d):
    docs = T.document_tokens(reviews(spark, d), ["review_id"], "review_text")
    return docs.select("review_id", F.size("tokens").alias("n_tokens"), F.md5(F.concat_ws(" ", "tokens")).alias("tokens"))


@query("m02_bags_of_words", TOK + """
, b AS (SELECT review_id, term, count(*) AS n FROM (SELECT review_id, unnest(k) AS term FROM doc) GROUP BY 1, 2),
v AS (SELECT term FROM b GROUP BY term HAVING count(*) >= 20 AND count(*) <= 0.4 * (SELECT count(*) FROM doc) ORDER BY count(*) DESC, term LIMIT 50000)
SELECT review_id, term, n FROM b WHERE term IN (SELECT term FROM v)
""", "reviews")
def bags_of_words(spark, d):
    return T.filtered_bags(T.document_tokens(reviews(spark, d), ["review_id"], "review_text"), ["review_id"], 20, 0.4, 50_000)


# Topic-like vectors: absolute embedding values as shares, one item per vector, genre from its part.
TOPIC = """, te AS (SELECT vec_id AS item_id, unnest(range(0, 64))::INT AS t, abs(CAST(unnest(embedding) AS DOUBLE)) AS a FROM embeddings),
tv AS (SELECT item_id, p_type AS genre, t, a / sum(a) OVER (PARTITION BY item_id) AS x FROM te JOIN part ON p_partkey = item_id)"""


def topic_items(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("vec"))
    v = v.withColumn("vec", T.share_vector("vec"))
    return v.join(table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("genre")), "item_id")


def longer(df, *keys, vec="vec", digits=6):
    return df.select(*keys, F.posexplode(vec).alias("t", "x")).withColumn("x", rnd("x", digits))


@query("m03_mean_topics", TOPIC + """
SELECT user_id, t, ROUND(avg(x), 6) AS x FROM interactions JOIN tv USING (item_id) GROUP BY 1, 2
""")
def mean_topics(spark, d):
    rows = interactions(spark, d).select("user_id", "item_id").join(topic_items(spark, d).select("item_id", "vec"), "item_id")
    return longer(T.mean_vectors(rows, "user_id", "vec", 64), "user_id")


@query("m05_fingerprints", "WITH " + TOPIC[2:] + """
, f AS (SELECT genre, t, avg(x) AS x FROM tv GROUP BY 1, 2)
SELECT genre, t, ROUND(x, 6) AS x, ROUND(x / sum(x) OVER (PARTITION BY genre), 6) AS share FROM f
""", "")
def fingerprints(spark, d):
    f = T.fingerprints(topic_items(spark, d), "genre", "vec", 64)
    both = f.select("genre", F.posexplode(F.arrays_zip("vec", "share")).alias("t", "z"))
    return both.select("genre", "t", rnd("z.vec").alias("x"), rnd("z.share").alias("share"))


@query("m06_discrimination", "WITH " + TOPIC[2:] + """
, f AS (SELECT genre, t, avg(x) AS m, var_samp(x) AS v FROM tv GROUP BY 1, 2)
SELECT t AS topic, ROUND(var_samp(m) / (avg(v) + 1e-9), 6) AS discrimination FROM f GROUP BY t ORDER BY var_samp(m) / (avg(v) + 1e-9) DESC, t LIMIT 20
""", "")
def discrimination(spark, d):
    out = T.discrimination(topic_items(spark, d), "genre", "vec", 64).orderBy(F.desc("discrimination"), "topic").limit(20)
    return rounded(out, "discrimination")


def affinity_sql(formulas, blend=True):
    names = list(formulas)
    sums = ", ".join(f"sum({f}) AS {n}" for n, f in formulas.items())
    raw = " UNION ALL ".join(f"SELECT user_id, genre, '{n}' AS variant, {n} AS raw FROM s" for n in names)
    smooth = "CASE WHEN is_bridge_user THEN 0.8 * p + 0.2 / n ELSE p END" if blend else "p"
    return f""", s AS (SELECT user_id, genre, {sums} FROM interactions GROUP BY 1, 2), raw AS ({raw}), gn AS (SELECT DISTINCT genre FROM interactions),
br AS (SELECT user_id, count(DISTINCT genre) >= 6 AS is_bridge_user FROM interactions GROUP BY 1),
grid AS (SELECT user_id, genre, variant FROM br, gn, (SELECT unnest({names}) AS variant)),
tot AS (SELECT user_id, variant, sum(raw) AS total FROM raw GROUP BY 1, 2),
sh AS (SELECT g.variant, g.user_id, g.genre, is_bridge_user, (SELECT count(*) FROM gn) AS n, CASE WHEN total < 1e-9 THEN 1.0 / (SELECT count(*) FROM gn) ELSE COALESCE(raw, 0) / total END AS p
 FROM grid g JOIN br USING (user_id) JOIN tot USING (user_id, variant) LEFT JOIN raw USING (user_id, genre, variant)),
af AS (SELECT variant, user_id, genre, is_bridge_user, {smooth} AS a FROM sh)"""


SQL_FORMULAS = {
    "f1_rating_votes": "rating/5.0*ln(1+total_votes)", "f2_rating_only": "rating/5.0", "f3_rating_length": "rating/5.0*ln(1+n_tokens)",
    "f4_rating_votes_length": "rating/5.0*ln(1+total_votes)*ln(1+n_tokens)", "f5_binary_positive": "CASE WHEN rating >= 4 THEN 1.0 ELSE 0.0 END",
}
F3 = {"f3_rating_length": SQL_FORMULAS["f3_rating_length"]}


def shares(spark, d, names, blend=0.2):
    rows = interactions(spark, d)
    formulas = S.edge_weights("rating", "total_votes", "n_tokens")
    bridge = P.user_stats(rows, "user_id", "genre", "ts", bridge_from=6).select("user_id", "is_bridge_user")
    return T.affinity(rows, "user_id", "item_id", "genre", {n: formulas[n] for n in names}, bridge, ["genre"], blend)


@query("m07_affinity", affinity_sql({"f1_rating_votes": SQL_FORMULAS["f1_rating_votes"]}, False) + " SELECT user_id, genre, ROUND(a, 6) AS affinity FROM af")
def affinity(spark, d):
    return rounded(shares(spark, d, ["f1_rating_votes"], 0.0).select("user_id", "genre", "affinity"), "affinity")


@query("m08_bridge_smoothing", affinity_sql(F3) + " SELECT user_id, genre, ROUND(a, 6) AS affinity, is_bridge_user FROM af")
def bridge_smoothing(spark, d):
    return rounded(shares(spark, d, ["f3_rating_length"]).select("user_id", "genre", "affinity", "is_bridge_user"), "affinity")


@query("m09_entropy", affinity_sql(F3) + """
SELECT user_id, ROUND(sum(-a * ln(a + 1e-9)), 6) AS entropy, arg_max(genre, (ROUND(a, 9), genre)) AS dominant FROM af GROUP BY 1
""")
def entropy(spark, d):
    return rounded(T.entropy_profile(shares(spark, d, ["f3_rating_length"]), "user_id", "genre").select("user_id", "entropy", "dominant"), "entropy")


@query("m10_affinity_variants", affinity_sql(SQL_FORMULAS) + " SELECT variant, user_id, genre, ROUND(a, 6) AS affinity FROM af")
def affinity_variants(spark, d):
    return rounded(shares(spark, d, list(SQL_FORMULAS)).select("variant", "user_id", "genre", "affinity"), "affinity")


@query("k12_simplex_checks", affinity_sql(SQL_FORMULAS) + """
, u AS (SELECT variant, user_id, is_bridge_user, sum(a) AS t, count(*) FILTER (WHERE a IS NULL) AS m, min(a) AS l, max(a) AS h, sum(-a * ln(a + 1e-9)) AS e FROM af GROUP BY 1, 2, 3)
SELECT variant, count(*) AS users, count(*) FILTER (WHERE t NOT BETWEEN 0.99 AND 1.01) AS bad_sums, CAST(sum(m) AS BIGINT) AS missing, count(*) FILTER (WHERE l < 0 OR h > 1 + 1e-9) AS out_of_range,
       ROUND(avg(e) FILTER (WHERE is_bridge_user), 6) AS bridge_entropy, ROUND(avg(e) FILTER (WHERE NOT is_bridge_user), 6) AS other_entropy FROM u GROUP BY 1
""")
def simplex_checks(spark, d):
    return rounded(T.simplex_checks(shares(spark, d, list(SQL_FORMULAS)), "user_id"), "bridge_entropy", "other_entropy")


TASTE = affinity_sql(F3) + TOPIC + ", fp AS (SELECT genre, t, avg(x) AS x FROM tv GROUP BY 1, 2), ut AS (SELECT user_id, t, sum(a * x) AS x FROM af JOIN fp USING (genre) GROUP BY 1, 2)"


def prints(spark, d):
    return T.fingerprints(topic_items(spark, d), "genre", "vec", 64)


@query("m11_taste", TASTE + " SELECT user_id, t, ROUND(x, 6) AS x FROM ut")
def taste(spark, d):
    return longer(T.taste(shares(spark, d, ["f3_rating_length"]), prints(spark, d), "user_id", "genre", "vec", 64), "user_id")


@query("m12_taste_card", TASTE + """
, g AS (SELECT user_id, string_agg(genre, '|' ORDER BY ROUND(a, 9) DESC, genre) AS genres, count(*) FILTER (WHERE a > 0.01)::INT AS active_genres, arg_max(genre, (ROUND(a, 9), -ascii(genre))) AS tg FROM af GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ROUND(x, 9) DESC, t) AS k FROM ut)
SELECT g.user_id, genres, active_genres, split_part(genres, '|', 1) AS top_genre, max(t) FILTER (WHERE k = 1) AS top_topic, 'topic ' || max(t) FILTER (WHERE k = 1) AS label,
       string_agg(CAST(t AS VARCHAR), '|' ORDER BY k) FILTER (WHERE k <= 8) AS topics FROM g JOIN r USING (user_id) GROUP BY g.user_id, genres, active_genres
""")
def taste_card(spark, d):
    profiles = T.taste_profile(shares(spark, d, ["f3_rating_length"]), prints(spark, d), "user_id", "genre", "vec", 64)
    labels = topic_items(spark, d).select(F.posexplode("vec").alias("topic", "x")).select("topic").distinct().withColumn("label", F.concat(F.lit("topic "), F.col("topic").cast("string")))
    card = T.taste_card(profiles, labels, "user_id", "vec")
    return card.select(
        "user_id", F.concat_ws("|", "genres_sorted").alias("genres"), "active_genres", "top_genre", "top_topic", "label",
        F.concat_ws("|", F.col("top_topics").cast("array<string>")).alias("topics"),
    )


# --------------------------------------------------------------------------- fitted topics and clusters

from prefmine.models import topics as L  # noqa: E402


def tokenised(spark, d):
    return stored(T.document_tokens(reviews(spark, d), ["review_id", "item_id"], "review_text"), "tokens")


@query("j12_lda_topics")
def lda_topics(spark, d):
    best, table_ = L.choose_topics(tokenised(spark, d), "review_id", list(L.TOPIC_COUNTS))
    return spark.createDataFrame([(k, round(s, 4), k == best.k) for k, s in table_], "k int, coherence double, chosen boolean")


@query("m04_topic_terms")
def topic_terms(spark, d):
    return rounded(L.fit_topics(tokenised(spark, d), L.TOPIC_COUNTS[0]).top_terms(10), "weight", digits=4)


@query("m03_book_topics")
def book_topics(spark, d):
    fit = L.fit_topics(tokenised(spark, d), L.TOPIC_COUNTS[0])
    return longer(T.mean_vectors(fit.vectors(["item_id"]), "item_id", "vec", L.TOPIC_COUNTS[0]), "item_id", digits=4)


@query("j13_topic_coherence", TOK + """
, dt AS (SELECT DISTINCT review_id, term FROM (SELECT review_id, unnest(k) AS term FROM doc)),
tt AS (SELECT genre AS topic, term FROM dt JOIN reviews USING (review_id) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY genre ORDER BY count(*) DESC, term) <= 10),
h AS (SELECT review_id, topic, term FROM dt JOIN tt USING (term)), j AS (SELECT a.topic, a.term AS t1, b.term AS t2, count(*) AS n12 FROM h a JOIN h b ON a.review_id = b.review_id AND a.topic = b.topic GROUP BY 1, 2, 3),
n AS (SELECT count(*) AS n FROM doc), s AS (SELECT topic, t1 AS t, n12 AS c FROM j WHERE t1 = t2),
f AS (SELECT a.topic, a.term AS t1, b.term AS t2, ln((COALESCE(n12, 0) / n + 1e-12) / (s1.c / n * s2.c / n)) / -ln(COALESCE(n12, 0) / n + 1e-12) AS v
 FROM tt a JOIN tt b ON a.topic = b.topic LEFT JOIN j ON j.topic = a.topic AND j.t1 = a.term AND j.t2 = b.term JOIN s s1 ON s1.topic = a.topic AND s1.t = a.term JOIN s s2 ON s2.topic = a.topic AND s2.t = b.term, n),
m AS (SELECT topic, t2, sum(v) AS s FROM f GROUP BY 1, 2), c AS (SELECT topic, t1, sum(v * s) / (sqrt(sum(v * v)) * sqrt(sum(s * s))) AS c FROM f JOIN m USING (topic, t2) GROUP BY 1, 2)
SELECT topic, ROUND(avg(c), 6) AS coherence FROM c GROUP BY 1
""", "reviews")
def coherence(spark, d):
    rows = tokenised(spark, d)
    docs = rows.select("review_id", F.explode("tokens").alias("term")).distinct()
    return rounded(T.topic_coherence(docs, "review_id", frequent_terms(spark, d, rows), rows.agg(F.count(F.lit(1))).scalar()), "coherence")


@query("j13_window_coherence", TOK + """
, dt AS (SELECT DISTINCT review_id, term FROM (SELECT review_id, unnest(k) AS term FROM doc)),
tt AS (SELECT genre AS topic, term FROM dt JOIN reviews USING (review_id) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY genre ORDER BY count(*) DESC, term) <= 10),
sz AS (SELECT review_id, greatest(len(k) - 110, 0) AS last, k FROM doc), n AS (SELECT sum(last + 1) AS n FROM sz),
ps AS (SELECT review_id, last, unnest(k) AS term, generate_subscripts(k, 1) - 1 AS p FROM sz),
h AS (SELECT DISTINCT review_id, topic, term, unnest(range(greatest(p - 109, 0), least(p, last) + 1)) AS w FROM ps JOIN tt USING (term)),
j AS (SELECT a.topic, a.term AS t1, b.term AS t2, count(*) AS n12 FROM h a JOIN h b ON a.review_id = b.review_id AND a.w = b.w AND a.topic = b.topic GROUP BY 1, 2, 3),
s AS (SELECT topic, t1 AS t, n12 AS c FROM j WHERE t1 = t2),
f AS (SELECT a.topic, a.term AS t1, b.term AS t2, ln((COALESCE(n12, 0) / n + 1e-12) / (s1.c / n * s2.c / n)) / -ln(COALESCE(n12, 0) / n + 1e-12) AS v
 FROM tt a JOIN tt b ON a.topic = b.topic LEFT JOIN j ON j.topic = a.topic AND j.t1 = a.term AND j.t2 = b.term JOIN s s1 ON s1.topic = a.topic AND s1.t = a.term JOIN s s2 ON s2.topic = a.topic AND s2.t = b.term, n),
m AS (SELECT topic, t2, sum(v) AS s FROM f GROUP BY 1, 2), c AS (SELECT topic, t1, sum(v * s) / (sqrt(sum(v * v)) * sqrt(sum(s * s))) AS c FROM f JOIN m USING (topic, t2) GROUP BY 1, 2)
SELECT topic, ROUND(avg(c), 6) AS coherence FROM c GROUP BY 1
""", "reviews")
def window_coherence(spark, d):
    rows = tokenised(spark, d)
    return rounded(T.window_coherence(rows, "review_id", frequent_terms(spark, d, rows)), "coherence")


def frequent_terms(spark, d, rows):
    """The ten most frequent terms of each genre, in the place of topics."""
    from prefmine.core import stored, top_per_key

    docs = rows.select("review_id", F.explode("tokens").alias("term")).distinct()
    genres = reviews(spark, d).select("review_id", F.col("genre").alias("topic"))
    counts = docs.join(genres, "review_id").groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n"))
    return stored(top_per_key(counts, ["topic"], [F.desc("n"), F.asc("term")], 10).select("topic", "term"), "frequent-terms")


def popular(spark, d):
    return P.popular_items(interactions(spark, d), "item_id", "rating", 20).select("item_id", "n_reviews", "avg_rating")


@query("j14_elbow")
def elbow(spark, d):
    return rounded(L.elbow(popular(spark, d), ["n_reviews", "avg_rating"], range(2, 12)), "inertia", digits=4)


@query("j14_clusters")
def clusters(spark, d):
    rows, centres, cost = L.cluster_items(popular(spark, d), ["n_reviews", "avg_rating"], 5)
    at = F.array(*[F.array(*[F.lit(x) for x in c]) for c in centres])
    out = L.cluster_summary(rows, "n_reviews", "avg_rating")
    out = out.withColumn("centre_reviews", F.get(F.get(at, "cluster"), F.lit(0))).withColumn("centre_rating", F.get(F.get(at, "cluster"), F.lit(1)))
    return rounded(out, "avg_reviews", "avg_rating", "centre_reviews", "centre_rating", digits=4)
