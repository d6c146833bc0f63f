"""Interaction, review and stage views over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line, read as a rating of a part by a customer."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    parts = table(spark, sf_dir, "part")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("item_id"),
            (1 + F.col("l_quantity").cast("int") % 5).alias("rating"),
            F.col("o_orderdate").alias("ts"),
            F.col("l_orderkey").alias("order_key"),
            F.col("l_linenumber").alias("line_no"),
            F.round(F.col("l_discount") * 100).cast("int").alias("total_votes"),
            F.round(F.col("l_tax") * 100).cast("int").alias("helpful_votes"),
            F.col("l_quantity").cast("int").alias("n_tokens"),
            F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("verified"),
            F.col("p_brand").alias("brand"),
            F.col("p_type").alias("genre"),
            F.col("p_retailprice").alias("price"),
            F.col("p_name").alias("title"),
        )
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, read as a text review by the customer of the order of that number, of one of
    as many items as there are twenty documents."""
    docs = table(spark, sf_dir, "documents")
    orders = table(spark, sf_dir, "orders")
    n_items = docs.agg(F.ceil(F.count(F.lit(1)) / 20)).scalar()
    return docs.join(orders, docs.doc_id == orders.o_orderkey).select(
        F.col("doc_id").alias("review_id"),
        F.col("o_custkey").alias("user_id"),
        (F.col("doc_id") % n_items).alias("item_id"),
        (1 + F.col("n_chars") % 5).cast("int").alias("rating"),
        F.col("o_orderdate").alias("ts"),
        F.col("source").alias("category"),
        F.col("lang").alias("genre"),
        F.col("text").alias("review_text"),
        "n_chars",
    )


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event, read as a step of the shelve, read, rate, recommend chain."""
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type") != "error")
        .select(
            "user_id",
            F.get_json_object("props", "$.k").cast("int").alias("item_id"),
            F.when(F.col("event_type") == "view", 0)
            .when(F.col("event_type") == "click", 1)
            .when(F.col("event_type") == "signup", 2)
            .otherwise(3)
            .alias("stage"),
            "ts",
            "event_id",
        )
    )


# Row key and total order of the interactions view.
KEY = ["order_key", "line_no", "item_id", "n_tokens"]
ORDER = ["ts", "user_id", "item_id", "order_key", "line_no", "n_tokens"]

# The same views for the SQL checks.
VIEWS = {
    "interactions": """interactions AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, 1 + CAST(l_quantity AS INT) % 5 AS rating, o_orderdate AS ts,
         l_orderkey AS order_key, l_linenumber AS line_no, CAST(ROUND(l_discount*100) AS INT) AS total_votes,
         CAST(ROUND(l_tax*100) AS INT) AS helpful_votes, CAST(l_quantity AS INT) AS n_tokens,
         CASE WHEN l_linestatus='F' THEN 1 ELSE 0 END AS verified, p_brand AS brand, p_type AS genre,
         p_retailprice AS price, p_name AS title
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey)""",
    "reviews": """reviews AS (
  SELECT doc_id AS review_id, o_custkey AS user_id, doc_id % (SELECT CAST(ceil(count(*) / 20) AS BIGINT) FROM documents) AS item_id, CAST(1 + n_chars % 5 AS INT) AS rating,
         o_orderdate AS ts, source AS category, lang AS genre, text AS review_text, n_chars
  FROM documents JOIN orders ON o_orderkey=doc_id)""",
    "stages": """stages AS (
  SELECT user_id, CAST(json_extract_string(props,'$.k') AS INT) AS item_id,
         CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS stage, ts, event_id
  FROM events WHERE event_type <> 'error')""",
}
