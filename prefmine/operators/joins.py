"""Joins of interactions with dimensions, statistics and each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmine.core import cut_lineage, null_safe_join, ratio, top_per_key


def admitted(df: DataFrame, rating: str, body: str, min_chars: int = 20) -> DataFrame:
    """Rated rows with a text longer than ``min_chars`` after trimming blanks."""
    return df.filter((F.col(rating) > 0) & F.col(body).isNotNull() & (F.length(F.trim(body)) > min_chars))


def unify(reviews: DataFrame, items: DataFrame, item: str, rating: str, body: str) -> DataFrame:
    """Admitted reviews with the attributes of their item; reviews of unknown items drop out."""
    return admitted(reviews, rating, body).join(items, item, "inner")


def attach_counts(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Adds the number of rows that share ``keys``."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return null_safe_join(df, counts, keys)


def match_rate(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct ids of ``left``, how many of them ``right`` has, and the rate."""
    ids = left.select(key).filter(F.col(key).isNotNull()).distinct()
    known = right.select(key, F.lit(True).alias("__hit")).distinct()
    hits = ids.join(known, key, "left").agg(
        F.count(F.lit(1)).alias("total_ids"), F.count("__hit").alias("matched_ids")
    )
    rate = ratio(F.col("matched_ids"), F.col("total_ids"))
    return hits.withColumn("rate", rate).withColumn("low_rate", F.col("rate") < 0.4)


def active_only(df: DataFrame, user: str, item: str, min_user: int = 5, min_item: int = 10) -> DataFrame:
    """Users with enough rows, then items with enough rows among what is left. One pass, no fixpoint."""
    users = df.groupBy(user).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_user)
    kept = df.join(users, user, "left_semi")
    items = kept.groupBy(item).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_item)
    return kept.join(items, item, "left_semi")


def warm_or_cold(test: DataFrame, train: DataFrame, user: str, item: str) -> DataFrame:
    """Adds ``user_known``, ``item_known`` and ``subset`` by membership in ``train``."""
    users = train.select(user).distinct().withColumn("__u", F.lit(True))
    items = train.select(item).distinct().withColumn("__i", F.lit(True))
    rows = test.join(users, user, "left").join(items, item, "left")
    rows = rows.withColumn("user_known", F.col("__u").isNotNull()).withColumn("item_known", F.col("__i").isNotNull())
    subset = (
        F.when(F.col("user_known") & F.col("item_known"), "warm")
        .when(F.col("item_known"), "cold_user")
        .when(F.col("user_known"), "cold_item")
        .otherwise("cold_both")
    )
    return rows.withColumn("subset", subset).drop("__u", "__i")


def having(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other``."""
    return df.join(other.select(*keys), keys, "left_semi")


def not_having(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other``."""
    return df.join(other.select(*keys), keys, "left_anti")


def lookup(df: DataFrame, values: DataFrame, key: str, value: str, default: Column, out: str) -> DataFrame:
    """Left join that replaces a missing value by ``default``."""
    right = values.select(key, F.col(value).alias("__value"))
    return df.join(right, key, "left").withColumn(out, F.coalesce("__value", default)).drop("__value")


def first_attribute(df: DataFrame, attributes: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Left join with one attribute row per key, the first in ``order``."""
    return df.join(top_per_key(attributes, [key], order), key, "left")


def shared_users_by_pair(df: DataFrame, user: str, label: str) -> DataFrame:
    """Users in common for every pair of labels.

    Users with the same set of labels are counted first, so pairs are formed once per distinct
    set and not once per user. The pairs of a set are emitted label by label, never held together.
    """
    sets = (
        df.filter(F.col(label).isNotNull() & F.col(user).isNotNull())
        .groupBy(user)
        .agg(F.array_sort(F.collect_set(label)).alias("__labels"))
        .groupBy("__labels")
        .agg(F.count(F.lit(1)).alias("__users"))
    )
    first = sets.select("__users", "__labels", F.posexplode("__labels").alias("__at", "label_a"))
    pairs = first.select(
        "__users", "label_a", F.explode(F.slice("__labels", F.col("__at") + 2, F.size("__labels"))).alias("label_b")
    )
    return pairs.groupBy("label_a", "label_b").agg(F.sum("__users").alias("users_overlap"))


def multiply(left: DataFrame, right: DataFrame, inner: str, rows: list[str], cols: list[str], a: str, b: str, out: str) -> DataFrame:
    """Sparse matrix product as join and sum: ``out[rows, cols] = sum over inner of a * b``.

    The left side is dealt by row key first, so a task adds up few output rows at a time, and where the right side is small
    no partial sums are shuffled.
    """
    return (
        left.select(*rows, inner, F.col(a).alias("__a")).repartition(*rows)
        .join(right.select(inner, *cols, F.col(b).alias("__b")), inner)
        .groupBy(*rows, *cols)
        .agg(F.sum(F.col("__a") * F.col("__b")).alias(out))
    )


def item_pairs(
    df: DataFrame, user: str, item: str, sums: dict[str, tuple[str, str]], chunk: int = 1000
) -> DataFrame:
    """Sums over users of products for every unordered item pair, plus ``common`` = shared users.

    ``df`` has one row per (user, item). A user's items are cut into chunks of about ``chunk``
    items and joined chunk pair by chunk pair, so a user who rated the whole catalogue is spread
    over many tasks. Both sides read the chunked rows from one written table, and products of one
    pair are summed before the shuffle. The result is the pair
    table itself, with items in ascending order.
    """
    n_chunks = F.ceil(F.col("__deg") / F.lit(chunk)).cast("int")
    deg = df.groupBy(user).agg(F.count(F.lit(1)).alias("__deg"))
    rows = df.join(deg, user).withColumn("__n", n_chunks).withColumn(
        "__chunk", F.pmod(F.xxhash64(item), F.col("__n")).cast("int")
    )
    rows = cut_lineage(rows.drop("__deg"))
    cells = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    values = sorted({c for pair in sums.values() for c in pair})
    left = cells.select(
        user, F.col(item).alias("item_a"), F.col("__chunk").alias("__ca"), F.col("__other").alias("__cb"),
        *[F.col(v).alias(f"__l_{v}") for v in values],
    )
    right = cells.select(
        user, F.col(item).alias("item_b"), F.col("__other").alias("__ca"), F.col("__chunk").alias("__cb"),
        *[F.col(v).alias(f"__r_{v}") for v in values],
    )
    pairs = left.join(right, [user, "__ca", "__cb"]).filter(F.col("item_a") < F.col("item_b"))
    aggs = [F.sum(F.col(f"__l_{a}") * F.col(f"__r_{b}")).alias(out) for out, (a, b) in sums.items()]
    return pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("common"), *aggs)
