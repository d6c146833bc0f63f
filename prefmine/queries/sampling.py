"""G: sampling and resampling. The SQL repeats the hash draws, so results are compared row by row."""

from pyspark.sql import functions as F

from prefmine.datasets import KEY, interactions, stages
from prefmine.functions.scalars import vote_weight
from prefmine.operators import profiles as P
from prefmine.operators import sampling as G
from prefmine.operators.graph import dense_index
from prefmine.queries.registry import query

K = ", ".join(KEY)


def hl(seed, *cols):
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(cols)})), 1, 12) AS BIGINT)"


def u(seed, *cols):
    return f"({hl(seed, *cols)} / 281474976710656.0)"


def keyed(df, *more):
    return df.select(*KEY, *more)


@query("g01_stratified_fraction", f"""
, n AS (SELECT brand, count(*) AS n FROM interactions GROUP BY brand)
SELECT {K} FROM interactions JOIN n USING (brand) WHERE {u(42, *KEY)} < 1000.0 / n
""")
def stratified_fraction(spark, d):
    return keyed(G.stratified_fraction(interactions(spark, d), "brand", KEY, 1000, 42))


@query("g01_stratified_cap", f"""
SELECT {K} FROM interactions QUALIFY row_number() OVER (PARTITION BY brand ORDER BY {u(42, *KEY)}, {K}) <= 1000
""")
def stratified_cap(spark, d):
    return keyed(G.stratified_cap(interactions(spark, d), "brand", KEY, 1000, 42))


@query("g02_bernoulli", f"SELECT {K} FROM interactions WHERE {u(7, *KEY)} < 0.01")
def bernoulli(spark, d):
    return keyed(G.bernoulli(interactions(spark, d), KEY, 0.01, 7))


@query("g03_fixed_size", f"SELECT {K} FROM interactions ORDER BY {u(3, *KEY)}, {K} LIMIT 3000")
def fixed_size(spark, d):
    return keyed(G.fixed_size(interactions(spark, d), KEY, 3000, 3))


@query("g04_weighted_sample", f"""
, c AS (SELECT genre, CASE WHEN quantile_cont(total_votes, 0.99) = 0 THEN 1.0 ELSE quantile_cont(total_votes, 0.99) END AS cap FROM interactions GROUP BY genre),
w AS (SELECT *, -ln({u(42, *KEY)} + power(2.0, -49)) / (ln(1 + least(total_votes, cap)) + 1e-6) AS k FROM interactions JOIN c USING (genre))
SELECT {K}, genre FROM w QUALIFY row_number() OVER (PARTITION BY genre ORDER BY k, {K}) <= 2000
""")
def weighted_sample(spark, d):
    rows = vote_weight(interactions(spark, d), "genre", "total_votes")
    return keyed(G.weighted_sample(rows, "genre", F.col("vote_weight") + 1e-6, KEY, 2000, 42), "genre")


# --- resampling: each step as SQL from one relation (with brand, user_id, copy_id and the key) to the next


def a_sql(src, out, total):
    return f"""
, {out}_n AS (SELECT brand, count(*) AS n FROM {src} GROUP BY brand),
{out}_x AS (SELECT brand, n, greatest(n, floor(n * (1 + 5.0 * (1.0 / ln(1 + n)) / ln(1 + {total}))))::BIGINT - n AS extra FROM {out}_n),
{out}_d AS (SELECT brand, k, floor({u(43, 'brand', 'k')} * n) + 1 AS idx FROM (SELECT brand, n, unnest(range(1, extra + 1)) AS k FROM {out}_x)),
{out}_i AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY {u(42, *KEY, 'copy_id')}, {K}, copy_id) AS idx FROM {src}),
{out} AS (SELECT brand, user_id, {K}, copy_id FROM {src} UNION ALL
 SELECT i.brand, i.user_id, {', '.join('i.' + k for k in KEY)}, i.copy_id || '.a' || d.k FROM {out}_d d JOIN {out}_i i ON d.brand = i.brand AND d.idx = i.idx)"""


def b_sql(src, out):
    return f"""
, {out}_c AS (SELECT brand, item_id, count(*) AS c, CAST(floor(sqrt(count(*)) * 1024) AS BIGINT) AS mass FROM {src} GROUP BY 1, 2),
{out}_l AS (SELECT *, CAST(sum(mass) OVER (PARTITION BY brand ORDER BY {u(44, 'brand', 'item_id')}, item_id) AS BIGINT) AS e,
  CAST(sum(mass) OVER (PARTITION BY brand) AS BIGINT) AS w, CAST(sum(c) OVER (PARTITION BY brand) AS BIGINT) AS n, {u(45, 'brand')} AS o FROM {out}_c),
{out}_m AS (SELECT *, CAST(ceil(e * n / w - o) - ceil((e - mass) * n / w - o) AS BIGINT) AS m FROM {out}_l),
{out}_r AS (SELECT *, row_number() OVER (PARTITION BY brand, item_id ORDER BY {u(46, *KEY, 'copy_id')}, {K}, copy_id) AS r FROM {src}),
{out}_k AS (SELECT x.*, CAST(floor(r * m / c) - floor((r - 1) * m / c) AS BIGINT) AS copies FROM {out}_r x JOIN {out}_m USING (brand, item_id)),
{out} AS (SELECT brand, user_id, {K}, copy_id || '.b' || k AS copy_id FROM (SELECT *, unnest(range(1, copies + 1)) AS k FROM {out}_k))"""


def c_sql(src, out):
    return f"""
, {out}_n AS (SELECT *, count(*) OVER (PARTITION BY brand, user_id) AS n FROM {src}),
{out} AS (SELECT brand, user_id, {K}, CASE WHEN k > 1 THEN copy_id || '.c' || k ELSE copy_id END AS copy_id
  FROM (SELECT *, unnest(range(1, CASE WHEN n < 5 THEN 4 ELSE 2 END)) AS k FROM {out}_n))"""


SRC = f", s0 AS (SELECT brand, user_id, {K}, '0' AS copy_id FROM interactions)"
N_ALL = "(SELECT count(*) FROM interactions)"


def source(spark, d):
    return interactions(spark, d).select("brand", "user_id", *KEY).withColumn("copy_id", F.lit("0"))


@query("g05_oversample", SRC + a_sql("s0", "s1", N_ALL) + f" SELECT {K}, copy_id FROM s1")
def oversample(spark, d):
    rows = source(spark, d)
    return keyed(G.oversample(rows, "brand", KEY, rows.agg(F.count(F.lit(1))).scalar()), "copy_id")


@query("g06_popularity_inverse", SRC + b_sql("s0", "s1") + f" SELECT {K}, copy_id FROM s1")
def popularity_inverse(spark, d):
    return keyed(G.popularity_inverse(source(spark, d), "brand", "item_id", KEY), "copy_id")


@query("g07_repeat_cold_users", SRC + c_sql("s0", "s1") + f" SELECT {K}, copy_id FROM s1")
def repeat_cold_users(spark, d):
    return keyed(G.repeat_cold_users(source(spark, d), "brand", "user_id"), "copy_id")


FLAGS = """
, fi AS (SELECT brand, item_id, count(*) AS x FROM interactions GROUP BY 1, 2), fr AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY x, item_id) AS k FROM fi),
fg AS (SELECT brand, 2 * sum(k * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*) AS gini FROM fr GROUP BY brand),
fu AS (SELECT brand, user_id, count(*) AS n FROM interactions GROUP BY 1, 2), fc AS (SELECT brand, avg(CASE WHEN n < 5 THEN 1.0 ELSE 0 END) AS cold_ratio FROM fu GROUP BY brand),
fb AS (SELECT brand, count(*) / (count(DISTINCT user_id) * count(DISTINCT item_id)) AS density FROM interactions GROUP BY brand),
flags AS (SELECT brand, COALESCE(NULLIF((CASE WHEN density < .026 THEN 'A' ELSE '' END) || (CASE WHEN gini > .10 THEN 'B' ELSE '' END) || (CASE WHEN cold_ratio > .958 THEN 'C' ELSE '' END), ''), 'none') AS type_flag
FROM fb JOIN fg USING (brand) JOIN fc USING (brand))"""


def split_by(src, letter):
    return f"""
, {src}_y AS (SELECT * FROM {src} WHERE brand IN (SELECT brand FROM flags WHERE type_flag LIKE '%{letter}%')),
{src}_z AS (SELECT * FROM {src} WHERE brand NOT IN (SELECT brand FROM flags WHERE type_flag LIKE '%{letter}%'))"""


RESAMPLE = (
    SRC + FLAGS + split_by("s0", "A") + a_sql("s0_y", "s1a", N_ALL) + ", s1 AS (SELECT * FROM s1a UNION ALL SELECT * FROM s0_z)"
    + split_by("s1", "B") + b_sql("s1_y", "s2b") + ", s2 AS (SELECT * FROM s2b UNION ALL SELECT * FROM s1_z)"
    + split_by("s2", "C") + c_sql("s2_y", "s3c") + ", s3 AS (SELECT * FROM s3c UNION ALL SELECT * FROM s2_z)"
)


@query("g08_resample_log", RESAMPLE + """
, b AS (SELECT brand, count(*) AS n_before FROM s0 GROUP BY brand), a AS (SELECT brand, count(*) AS n_after FROM s3 GROUP BY brand)
SELECT brand, type_flag, n_before, n_after, ROUND(n_after / n_before, 3) AS ratio FROM b JOIN a USING (brand) JOIN flags USING (brand)
""")
def resample_log(spark, d):
    rows = interactions(spark, d).select("brand", "user_id", *KEY)
    flags = P.sparsity_flags(P.sparsity_metrics(rows, "brand", "user_id", "item_id"), 0.026, 0.10, 0.958)
    return G.resample_log(rows, G.resample(rows, flags, "brand", "user_id", "item_id", KEY), "brand")


@query("g09_sample_users", f"""
, c AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM interactions) ORDER BY {u(1234, 'user_id')}, user_id LIMIT 500)
SELECT user_id, count(*) AS n FROM interactions WHERE user_id IN (SELECT user_id FROM c) GROUP BY user_id
""")
def sample_users(spark, d):
    return G.sample_users(interactions(spark, d), "user_id", 500, 1234).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


HOLDOUT = f"""
, f AS (SELECT * FROM stages WHERE stage = 3), e AS (SELECT user_id FROM f GROUP BY user_id HAVING count(*) >= 3),
o AS (SELECT user_id, row_number() OVER (ORDER BY {u(42, 'user_id')}, user_id) AS r, least(40, floor(count(*) OVER () / 2)) AS v FROM e),
h AS (SELECT user_id, CASE WHEN r <= v THEN 'val' WHEN r <= v + 40 THEN 'test' END AS side FROM o),
p AS (SELECT user_id, event_id FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {u(43, 'event_id')}, event_id) = 1),
held AS (SELECT s.*, COALESCE(x.side, 'train') AS split FROM stages s LEFT JOIN (SELECT p.event_id, side FROM p JOIN h USING (user_id) WHERE side IS NOT NULL) x USING (event_id))
"""


@query("g10_leave_one_out", HOLDOUT + "SELECT event_id, split FROM held", "stages")
def leave_one_out(spark, d):
    return G.leave_one_out(stages(spark, d), "user_id", "stage", ["event_id"], 40, 40).select("event_id", "split")


def negatives_sql(src, wants, seen, seed, out="neg"):
    """``out(user_id, item_id, draw)`` from a relation of users and wanted numbers, of items ``src`` and of seen pairs."""
    return f"""
, {out}_ix AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM {src})),
{out}_sz AS (SELECT count(*) AS n, (SELECT min(q) FROM range((SELECT count(*) FROM {out}_ix), (SELECT count(*) FROM {out}_ix) + 300) t(q)
   WHERE NOT EXISTS (SELECT 1 FROM range(2, CAST(floor(sqrt(q)) AS BIGINT) + 1) z(f) WHERE q % f = 0)) AS p FROM {out}_ix),
{out}_ld AS (SELECT user_id, count(DISTINCT item_id) AS s FROM {seen} GROUP BY 1),
{out}_wk AS (SELECT w.user_id, want, least(p, COALESCE(s, 0) + want + (p - n)) AS steps, p, {hl(seed, 'w.user_id')} % p AS a, 1 + {hl(seed + 1, 'w.user_id')} % (p - 1) AS b
   FROM ({wants}) w LEFT JOIN {out}_ld l ON w.user_id = l.user_id, {out}_sz),
{out}_dr AS (SELECT user_id, want, j + 1 AS draw, (a + b * j) % p AS idx FROM (SELECT *, unnest(range(0, steps)) AS j FROM {out}_wk)),
{out} AS (SELECT user_id, item_id, draw FROM {out}_dr JOIN {out}_ix USING (idx) ANTI JOIN {seen} USING (user_id, item_id)
   QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY draw) <= want)"""


@query("g11_ranking_negatives", negatives_sql("interactions", "SELECT DISTINCT user_id, 100 AS want FROM interactions", "interactions", 5) + " SELECT user_id, item_id, draw FROM neg")
def ranking_negatives(spark, d):
    rows = interactions(spark, d).select("user_id", "item_id")
    return G.sample_negatives(rows, dense_index(rows, "item_id"), rows, "user_id", "item_id", 100, 5)


@query("g12_training_negatives", negatives_sql("stages", "SELECT user_id, count(*) AS want FROM stages GROUP BY 1", "stages", 11) + f"""
, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY draw) AS k, count(*) OVER (PARTITION BY user_id) AS m FROM neg),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {u(18, 'event_id')}, event_id) AS r FROM stages)
SELECT r.user_id, event_id, k.item_id AS negative, stage FROM r JOIN k ON r.user_id = k.user_id AND (r.r - 1) % k.m + 1 = k.k
""", "stages")
def training_negatives(spark, d):
    rows = stages(spark, d)
    return G.training_negatives(rows, dense_index(rows, "item_id"), rows, "user_id", "item_id", "stage", ["event_id"], 11)


@query("g13_shuffle", f"""
SELECT event_id, row_number() OVER (ORDER BY {u(42, 'event_id')}, event_id) AS position FROM stages
""", "stages")
def shuffle(spark, d):
    from prefmine.core import global_position, hash_uniform

    rows = stages(spark, d).select("event_id").withColumn("h", hash_uniform(42, "event_id"))
    return global_position(rows, [F.col("h"), F.col("event_id")]).select("event_id", "position")
