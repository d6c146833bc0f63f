"""A: sources and sinks. Every query writes one of the given tables out in the format at hand and reads it back."""

from pyspark.sql import functions as F

from prefmine.core import rnd, scratch_path
from prefmine.datasets import KEY, interactions, reviews, stages, table
from prefmine.queries.registry import query
from prefmine.sources import readers as R
from prefmine.sources import schemas as C
from prefmine.sources import sinks as K


def retail(spark, d):
    """The interactions in the shape of a retail review file."""
    t = lambda c: F.col(c).cast("string")
    return interactions(spark, d).select(
        F.lit("US").alias("marketplace"), t("user_id").alias("customer_id"), F.concat_ws("-", *KEY).alias("review_id"), t("item_id").alias("product_id"),
        t("order_key").alias("product_parent"), F.col("title").alias("product_title"), F.col("brand").alias("product_category"), F.col("rating").alias("star_rating"),
        "helpful_votes", "total_votes", F.lit("N").alias("vine"), F.when(F.col("verified") == 1, "Y").otherwise("N").alias("verified_purchase"),
        F.col("genre").alias("review_headline"), F.concat(F.lit('said "'), F.col("title"), F.lit('",\nthen left\t')).alias("review_body"),
        F.to_date("ts").alias("review_date"),
    )


def write_tsv(df, path):
    df.write.mode("overwrite").options(sep="\t", header="true", quote='"', escape='"', quoteAll="true", ignoreTrailingWhiteSpace="false").csv(path)


_KEY = "concat_ws('-', order_key, line_no, item_id, n_tokens)"


@query("a01_tsv_scan", f"""
SELECT {_KEY} AS review_id, rating AS star_rating, ts::DATE AS review_date, length(title)::INT + 19 AS body_chars, FALSE AS corrupt FROM interactions
""")
def tsv_scan(spark, d):
    path = scratch_path(spark, "tsv")
    write_tsv(retail(spark, d), path)
    return R.read_tsv(spark, path).select(
        "review_id", "star_rating", "review_date", F.length("review_body").alias("body_chars"), F.col("_corrupt_record").isNotNull().alias("corrupt")
    )


@query("a02_declared_schema", f"""
SELECT {_KEY} AS review_id, CASE WHEN rating = 3 THEN NULL ELSE rating END AS star_rating, total_votes, CASE WHEN verified = 1 THEN 'Y' ELSE 'N' END AS verified_purchase,
       ts::DATE AS review_date FROM interactions
""")
def declared_schema(spark, d):
    text = retail(spark, d).select(*[F.col(c).cast("string").alias(c) for c in C.RETAIL_REVIEW.names])
    text = text.withColumn("star_rating", F.when(F.col("star_rating") == "3", "three").otherwise(F.col("star_rating")))
    return C.conform(text, C.RETAIL_REVIEW).select("review_id", "star_rating", "total_votes", "verified_purchase", "review_date")


@query("a03_load_data", """
SELECT rating AS star_rating, count(*) AS n_parquet, count(*) AS n_tsv FROM interactions GROUP BY 1
""")
def load_data(spark, d):
    parquet, tsv = scratch_path(spark, "load-parquet"), scratch_path(spark, "load-tsv")
    rows = retail(spark, d)
    rows.write.parquet(parquet)
    write_tsv(rows, tsv)
    sides = [R.load_data(spark, p, f).groupBy("star_rating").agg(F.count(F.lit(1)).alias(f"n_{f}")) for p, f in ((parquet, "parquet"), (tsv, "tsv"))]
    return sides[0].join(sides[1], "star_rating")


@query("a04_hive_scan", "SELECT order_key, line_no, item_id, n_tokens, rating AS overall FROM interactions")
def hive_scan(spark, d):
    path = scratch_path(spark, "hive")
    rows = interactions(spark, d).select(*KEY, F.col("rating").alias("overall"))
    K.write_partitioned(rows, path, "overall")
    rows.drop("overall").limit(10).write.parquet(f"{path}/stray")
    return R.read_hive_rating(spark, path)


@query("a05_union_by_name", """
SELECT order_key, line_no, item_id, n_tokens, CASE WHEN rating < 3 THEN brand END AS brand, CASE WHEN rating >= 3 THEN genre END AS genre FROM interactions
""")
def union_by_name(spark, d):
    path = scratch_path(spark, "union")
    rows = interactions(spark, d)
    rows.filter("rating < 3").select(*KEY, "brand").write.parquet(f"{path}/low")
    rows.filter("rating >= 3").select("genre", *KEY).write.parquet(f"{path}/high")
    return R.read_union_by_name(spark, f"{path}/*").select(*KEY, "brand", "genre")


@query("a06_column_pruning", "SELECT l_orderkey, l_quantity FROM lineitem", "")
def column_pruning(spark, d):
    return R.read_columns(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("a07_json_lines", """
SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS book_id, CAST(review_id AS VARCHAR) AS review_id, CAST(rating AS TINYINT) AS rating, length(review_text)::INT AS n_chars,
       '' AS read_at, 0 AS n_votes FROM reviews WHERE rating <> 5
""", "reviews")
def json_lines(spark, d):
    path = scratch_path(spark, "json")
    rows = reviews(spark, d)
    text = F.to_json(F.struct(
        *[F.col(c).cast("string").alias(n) for c, n in (("user_id", "user_id"), ("item_id", "book_id"), ("review_id", "review_id"))], "rating", "review_text"
    ))
    broken = F.concat(F.lit("{broken "), F.col("review_id").cast("string"))
    rows.select(F.when(F.col("rating") == 5, broken).otherwise(text).alias("value")).write.text(path)
    out = R.read_json_lines(spark, path)
    return out.select("user_id", "book_id", "review_id", "rating", F.length("review_text").alias("n_chars"), "read_at", "n_votes")


@query("a08_nested_json", """
, g AS (SELECT user_id, genre, count(*) AS n FROM interactions GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, genre) AS k FROM g)
SELECT CAST(user_id AS VARCHAR) AS book_id, max(genre) FILTER (WHERE k = 1) AS primary_genre, max(genre) FILTER (WHERE k = 2) AS genre_2, max(genre) FILTER (WHERE k = 3) AS genre_3,
       max(n) FILTER (WHERE k = 1) AS primary_genre_count FROM r GROUP BY user_id
""")
def nested_json(spark, d):
    path = scratch_path(spark, "genres")
    counts = interactions(spark, d).groupBy("user_id", "genre").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy(F.col("user_id").cast("string").alias("book_id")).agg(F.map_from_entries(F.collect_list(F.struct("genre", "n"))).alias("genres"))
    maps.write.option("compression", "gzip").json(path)
    return R.read_genres(spark, path)


@query("a08_book_meta", """
SELECT CAST(p_partkey AS VARCHAR) AS book_id, p_name AS title, CASE WHEN p_size > 25 THEN '' ELSE p_type END AS description,
       CASE WHEN p_size > 40 THEN '' ELSE p_brand END AS author_id, CAST(p_size AS VARCHAR) AS num_pages, '' AS publication_year FROM part
""", "")
def book_meta(spark, d):
    path = scratch_path(spark, "meta")
    parts = table(spark, d, "part")
    author = F.struct(F.col("p_brand").alias("author_id"), F.lit("x").alias("role"))
    parts.select(
        F.col("p_partkey").cast("string").alias("book_id"), F.col("p_name").alias("title"), F.when(F.col("p_size") <= 25, F.col("p_type")).alias("description"),
        F.when(F.col("p_size") <= 40, F.array(author, author)).alias("authors"), F.col("p_size").cast("string").alias("num_pages"),
    ).write.option("compression", "gzip").json(path)
    return R.read_book_meta(spark, path).select("book_id", "title", "description", "author_id", "num_pages", "publication_year")


@query("a09_typed_csv", """
SELECT CAST(user_id AS INT) AS user_id, item_id AS book_id, CAST(CASE WHEN stage >= 1 THEN 1 ELSE 0 END AS TINYINT) AS is_read, CAST(stage AS TINYINT) AS rating FROM stages
""", "stages")
def typed_csv(spark, d):
    path = scratch_path(spark, "csv")
    stages(spark, d).select("user_id", F.col("item_id").alias("book_id"), (F.col("stage") >= 1).cast("int").alias("is_read"), F.col("stage").alias("rating")).write.option("header", "true").csv(path)
    return R.read_chain_csv(spark, path)


@query("a10_inventory", "SELECT rating AS overall, count(*) AS rows, TRUE AS readable FROM interactions GROUP BY 1")
def inventory(spark, d):
    path = scratch_path(spark, "inventory")
    K.write_partitioned(interactions(spark, d).select(*KEY, F.col("rating").alias("overall")), path, "overall")
    files = R.inventory(spark, path)
    return files.groupBy(F.regexp_extract("path", r"overall=(\d+)", 1).cast("int").alias("overall")).agg(
        F.sum("rows").alias("rows"), F.bool_and(F.col("readable") & (F.col("bytes") > 0)).alias("readable")
    )


@query("a10_inventory_by_brand", "SELECT brand, count(*) AS rows, TRUE AS readable FROM interactions GROUP BY 1")
def inventory_by_brand(spark, d):
    path = scratch_path(spark, "inventory")
    K.write_partitioned(interactions(spark, d).select(*KEY, "brand"), path, "brand")
    brand = F.url_decode(F.regexp_extract("path", r"brand=([^/]+)", 1))
    return R.inventory(spark, path).groupBy(brand.alias("brand")).agg(F.sum("rows").alias("rows"), F.bool_and(F.col("readable")).alias("readable"))


@query("a11_partitioned_sink", "SELECT brand, count(*) AS n, CAST(sum(rating) AS BIGINT) AS total FROM interactions GROUP BY brand")
def partitioned_sink(spark, d):
    path = scratch_path(spark, "partitioned")
    K.write_partitioned(interactions(spark, d).select(*KEY, "rating", "brand"), path, "brand")
    return spark.read.parquet(path).groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("total"))


@query("a12_compressed_sink", "SELECT order_key, line_no, item_id, n_tokens, TRUE AS zstd FROM interactions")
def compressed_sink(spark, d):
    path = scratch_path(spark, "zstd")
    K.write_compressed(interactions(spark, d).select(*KEY), path)
    return spark.read.parquet(path).select(*KEY, F.col("_metadata.file_name").contains(".zstd.").alias("zstd"))


@query("a13_row_bounded_sink", "SELECT count(*) AS n, TRUE AS bounded FROM interactions")
def row_bounded_sink(spark, d):
    path = scratch_path(spark, "bounded")
    K.write_bounded(interactions(spark, d).select(*KEY), path, 5000)
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return files.agg(F.sum("n").alias("n"), (F.max("n") <= 5000).alias("bounded"))


@query("a14_clean_category_sink", """
SELECT replace(replace(genre || '/' || brand, ' ', '_'), '/', '_') AS slug, count(*) AS n FROM interactions GROUP BY 1
""")
def clean_category_sink(spark, d):
    path = scratch_path(spark, "clean")
    rows = interactions(spark, d).withColumn("category", F.concat_ws("/", "genre", "brand"))
    for part in (rows.filter("rating < 3"), rows.filter("rating >= 3")):
        K.write_clean_by_category(part, path, "category", KEY)
    return spark.read.parquet(path).groupBy("slug").agg(F.count(F.lit(1)).alias("n"))


@query("a15_compaction", "SELECT order_key, line_no, item_id, n_tokens, genre || ', ' || brand AS genre FROM interactions")
def compaction(spark, d):
    many, few = scratch_path(spark, "many"), scratch_path(spark, "few")
    rows = interactions(spark, d).select(*KEY, F.concat_ws(", ", "genre", "brand").alias("genre"))
    rows.repartition(8).write.partitionBy("genre").parquet(many)
    K.compact(spark.read.parquet(many), few, "genre")
    return spark.read.parquet(few).select(*KEY, "genre")


@query("a16_report_sink", "SELECT brand, count(*) AS n_csv, count(*) AS n_json FROM interactions GROUP BY brand")
def report_sink(spark, d):
    path = scratch_path(spark, "report")
    K.write_report(interactions(spark, d).groupBy("brand").agg(F.count(F.lit(1)).alias("n")), path)
    csv = spark.read.schema("brand string, n_csv bigint").option("header", "true").csv(f"{path}/csv")
    return csv.join(spark.read.schema("brand string, n bigint").json(f"{path}/json").withColumnRenamed("n", "n_json"), "brand")


@query("a17_run_summary", """
, s AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY ts, user_id, item_id, order_key, line_no, n_tokens) <= floor(0.8 * (SELECT count(*) FROM interactions)) THEN 'train' ELSE 'test' END AS split FROM interactions)
SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items,
       ROUND(avg(rating) FILTER (WHERE split = 'train'), 6) AS global_mean, strftime(min(ts) FILTER (WHERE split = 'test'), '%Y-%m-%d') AS split_date FROM s
""")
def run_summary(spark, d):
    from prefmine.datasets import ORDER
    from prefmine.operators.graph import temporal_split

    path = scratch_path(spark, "summary")
    split = temporal_split(interactions(spark, d), 0.8, ORDER)
    K.write_summary(K.summary(split, "split", "user_id", "item_id", "rating", "ts"), path)
    out = spark.read.schema("n_train bigint, n_test bigint, n_users bigint, n_items bigint, global_mean double, split_date string").json(path)
    return out.withColumn("global_mean", rnd("global_mean"))


@query("a18_schema_contract", """
SELECT 'review_id' AS column_name, 'bigint' AS column_type, FALSE AS required, (SELECT count(*) FROM reviews) AS total_rows, (SELECT max(ts)::DATE FROM reviews) AS latest
UNION ALL SELECT 'user_id', 'bigint', TRUE, (SELECT count(*) FROM reviews), (SELECT max(ts)::DATE FROM reviews)
UNION ALL SELECT 'rating', 'int', TRUE, (SELECT count(*) FROM reviews), (SELECT max(ts)::DATE FROM reviews)
UNION ALL SELECT 'ts', 'timestamp_ntz', TRUE, (SELECT count(*) FROM reviews), (SELECT max(ts)::DATE FROM reviews)
""", "reviews")
def schema_contract(spark, d):
    rows = reviews(spark, d).select("review_id", "user_id", "rating", "ts")
    latest = rows.agg(F.max(F.to_date(C.timestamp_of(rows, "ts")))).scalar()
    return C.contract(rows, {"user_id", "rating", "ts"}).withColumn("latest", latest)
