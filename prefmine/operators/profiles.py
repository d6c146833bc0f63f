"""Aggregations that describe a review log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefmine.core import grouped_quantiles, null_safe_join, pct, ratio, stored, value_percentiles
from prefmine.functions.scalars import VOLUME_TIERS, bucket_label


def rows() -> Column:
    return F.count(F.lit(1))


def has_text(body: str) -> Column:
    return F.col(body).isNotNull() & (F.length(F.trim(body)) > 0)


def in_range(rating: str) -> Column:
    """The rating where it is a valid star, else null."""
    return F.when(F.col(rating).between(1, 5), F.col(rating).cast("double"))


def validation_profile(df: DataFrame, key, item, rating, body, helpful, total, date, low: int = 1, high: int = 5) -> DataFrame:
    """Every data-quality count in one pass."""
    r = F.col(rating)
    return df.agg(
        rows().alias("total_rows"),
        F.count_if(F.col(key).isNull()).alias("null_review_id"),
        F.count_if(F.col(item).isNull()).alias("null_product_id"),
        F.count_if(r.isNull()).alias("null_star_rating"),
        F.count_if(F.col(body).isNull()).alias("null_review_body"),
        F.count_if((r < low) | (r > high)).alias("invalid_rating"),
        F.count_if(F.col(helpful) > F.col(total)).alias("vote_inconsistency"),
        F.count_if(F.col(body).isNull() | (F.col(body) == "")).alias("empty_reviews"),
        F.count_if(F.length(body) < 10).alias("short_reviews"),
        F.min(F.to_date(date)).alias("min_date"),
        F.max(F.to_date(date)).alias("max_date"),
    )


def overview(df: DataFrame, user: str, item: str, rating: str, date: str, body: str) -> DataFrame:
    base = df.agg(
        rows().alias("total_reviews"), F.countDistinct(user).alias("unique_users"), F.countDistinct(item).alias("unique_items"),
        F.min(F.to_date(date)).alias("earliest_date"), F.max(F.to_date(date)).alias("latest_date"),
        F.avg(in_range(rating)).alias("avg_rating"), F.count_if(has_text(body)).alias("reviews_with_text"),
    )
    return base.withColumn(
        "pct_reviews_with_text", ratio(F.col("reviews_with_text") * F.lit(100.0), F.col("total_reviews"))
    )


def density(df: DataFrame, user: str, item: str, keys: list[str] | None = None) -> DataFrame:
    """Size and sparsity of the user x item matrix, overall or per key."""
    base = df.groupBy(*(keys or [])).agg(
        rows().alias("n_reviews"), F.countDistinct(user).alias("n_users"), F.countDistinct(item).alias("n_items")
    )
    n, u, i = (F.col(c).cast("double") for c in ("n_reviews", "n_users", "n_items"))
    filled = ratio(n, u * i)
    return (
        base.withColumn("avg_per_user", ratio(n, u)).withColumn("avg_per_item", ratio(n, i))
        .withColumn("density", filled).withColumn("sparsity", 1 - filled)
    )


def rating_histogram(df: DataFrame, rating: str) -> DataFrame:
    """Counts, shares and running shares of the five stars, with the mean."""
    counts = df.filter(F.col(rating).between(1, 5)).groupBy(rating).agg(rows().alias("n"))
    everything, upward = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(rating)
    total = F.sum("n").over(everything)
    return counts.select(
        rating, "n", (F.col("n") * 100.0 / total).alias("pct"), (F.sum("n").over(upward) * 100.0 / total).alias("cum_pct"),
        (F.sum(F.col(rating) * F.col("n")).over(everything) / total).alias("mean_rating"),
    )


def sentiment_shares(df: DataFrame, rating: str) -> DataFrame:
    r = F.col(rating)
    return df.agg(
        rows().alias("total"), F.count_if(r >= 4).alias("positive"), F.count_if(r <= 2).alias("negative"),
        F.count_if(r == 5).alias("five_star"), F.count_if(r == 1).alias("one_star"), pct(r >= 4).alias("pct_positive"),
    )


def per_entity_counts(df: DataFrame, entity: str, out: str = "n_reviews") -> DataFrame:
    return df.groupBy(entity).agg(rows().alias(out))


def count_distribution(df: DataFrame, entity: str) -> DataFrame:
    """How many entities have how many rows: a small table that all long-tail statistics start from."""
    return per_entity_counts(df, entity).groupBy("n_reviews").agg(rows().alias("n_entities"))


def describe_counts(df: DataFrame, entity: str, probs: dict[str, float]) -> DataFrame:
    """Mean, spread, range and percentiles of rows per entity."""
    n, f = F.col("n_reviews"), F.col("n_entities")
    s0, s1 = F.sum(f), F.sum(n * f)
    mean = s1 / s0
    dist = count_distribution(df, entity)
    return dist.agg(
        s0.alias("entities"), mean.alias("mean_reviews"),
        F.sqrt(F.try_divide(F.sum(n * n * f) - s1 * s1 / s0, s0 - 1)).alias("std_reviews"),
        F.min(n).alias("min_reviews"), F.max(n).alias("max_reviews"),
        *[F.percentile("n_reviews", F.lit(p), f).alias(name) for name, p in probs.items()],
        (F.sum(F.when(n == 1, f).otherwise(0)) * 100.0 / s0).alias("pct_one_review"),
    )


def user_segments(df: DataFrame, user: str) -> DataFrame:
    n = F.col("n_reviews")
    return per_entity_counts(df, user).agg(
        F.count_if(n == 1).alias("users_1_review"), F.count_if(n.between(2, 5)).alias("users_2to5"),
        F.count_if(n > 5).alias("users_5plus"), rows().alias("total_users"),
    )


def category_profile(df: DataFrame, category: str, user: str, item: str, rating: str, extra: dict[str, Column] | None = None) -> DataFrame:
    return df.groupBy(category).agg(
        rows().alias("reviews"), F.countDistinct(item).alias("items"), F.countDistinct(user).alias("users"),
        F.avg(in_range(rating)).alias("avg_rating"), *[c.alias(n) for n, c in (extra or {}).items()],
    )


def group_mean(df: DataFrame, key: str, rating: str) -> DataFrame:
    return df.groupBy(key).agg(rows().alias("reviews"), F.avg(rating).alias("avg_rating"))


def cold_start(df: DataFrame, entities: dict[str, str]) -> DataFrame:
    """Per kind of entity: how many have fewer than 5 and 10 rows, mean and median."""
    parts = []
    for label, entity in entities.items():
        n, f = F.col("n_reviews"), F.col("n_entities")
        parts.append(
            count_distribution(df, entity).agg(
                F.lit(label).alias("entity"), F.sum(f).alias("n_entities_total"),
                F.sum(F.when(n < 5, f).otherwise(0)).alias("n_lt5"), F.sum(F.when(n < 10, f).otherwise(0)).alias("n_lt10"),
                (F.sum(n * f) / F.sum(f)).alias("avg_reviews"), F.percentile("n_reviews", F.lit(0.5), f).alias("median_reviews"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    total = F.col("n_entities_total")
    return (
        out.withColumn("pct_lt5", F.col("n_lt5") * 100.0 / total).withColumn("pct_lt10", F.col("n_lt10") * 100.0 / total)
        .withColumnRenamed("n_entities_total", "n_entities")
    )


def bucket_shares(df: DataFrame, entity: str, tiers) -> DataFrame:
    """Entities per activity bucket and their share."""
    counts = per_entity_counts(df, entity).groupBy(bucket_label("n_reviews", tiers).alias("bucket")).agg(rows().alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def yearly_activity(df: DataFrame, date: str, user: str, rating: str, body: str) -> DataFrame:
    return df.filter(F.col(date).isNotNull()).groupBy(F.year(date).alias("yr")).agg(
        rows().alias("reviews"), F.countDistinct(user).alias("active_users"), F.avg(in_range(rating)).alias("avg_rating"),
        pct(has_text(body)).alias("pct_has_text"),
    )


def first_year_cohorts(df: DataFrame, date: str, user: str) -> DataFrame:
    first = df.filter(F.col(date).isNotNull()).groupBy(user).agg(F.min(F.year(date)).alias("yr"))
    new = first.groupBy("yr").agg(rows().alias("new_users"))
    return new.withColumn("cumulative_users", F.sum("new_users").over(Window.partitionBy(F.lit(0)).orderBy("yr")))


def monthly_activity(df: DataFrame, date: str, user: str, rating: str) -> DataFrame:
    return df.filter(F.col(date).isNotNull()).groupBy(F.to_date(F.date_trunc("month", date)).alias("month")).agg(
        rows().alias("reviews"), F.avg(in_range(rating)).alias("avg_rating"), F.countDistinct(user).alias("active_users")
    )


def moving_average(monthly: DataFrame, order: str, columns: list[str], width: int = 3) -> DataFrame:
    """Trailing mean over up to ``width`` rows. One row per month, so one window is enough."""
    w = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(1 - width, 0)
    return monthly.select("*", *[F.avg(c).over(w).alias(f"{c}_ma{width}") for c in columns])


def positivity_by_year(df: DataFrame, date: str, rating: str) -> DataFrame:
    r = F.col(rating)
    return df.filter(F.col(date).isNotNull() & r.between(1, 5)).groupBy(F.year(date).alias("yr")).agg(
        rows().alias("reviews"), pct(r >= 4).alias("pct_4plus"), pct(r == 5).alias("pct_5star"), F.avg(r).alias("avg_rating")
    )


def rating_by_year(df: DataFrame, date: str, rating: str) -> DataFrame:
    return df.filter(F.col(date).isNotNull() & F.col(rating).between(1, 5)).groupBy(F.year(date).alias("yr"), rating).agg(rows().alias("n"))


def rating_year_pivot(by_year: DataFrame, rating: str) -> DataFrame:
    """One row per year: share of each star, weighted mean, change of the mean since the first year."""
    stars = [
        (F.coalesce(F.sum(F.when(F.col(rating) == s, F.col("n"))), F.lit(0)) * 100.0 / F.sum("n")).alias(f"pct_{s}")
        for s in range(1, 6)
    ]
    yearly = by_year.groupBy("yr").agg(*stars, (F.sum(F.col(rating) * F.col("n")) / F.sum("n")).alias("mean_rating"))
    first = F.first("mean_rating").over(Window.partitionBy(F.lit(0)).orderBy("yr"))
    return yearly.withColumn("drift", F.col("mean_rating") - first)


def shares_within(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts of ``inner`` within ``outer`` and their share in percent."""
    counts = df.filter(F.col(outer).isNotNull()).groupBy(outer, inner).agg(rows().alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(outer)))


def breadth(df: DataFrame, user: str, label: str) -> DataFrame:
    """How many users touch how many labels."""
    per_user = df.filter(F.col(label).isNotNull()).groupBy(user).agg(F.countDistinct(label).alias("n_labels"))
    counts = per_user.groupBy("n_labels").agg(rows().alias("users"))
    return counts.withColumn("pct_users", F.col("users") * 100.0 / F.sum("users").over(Window.partitionBy(F.lit(0))))


def split_profile(df: DataFrame, split: str, user: str, item: str, date: str, rating: str) -> DataFrame:
    return df.groupBy(split).agg(
        rows().alias("reviews"), F.countDistinct(user).alias("users"), F.countDistinct(item).alias("items"),
        F.min(F.to_date(date)).alias("earliest"), F.max(F.to_date(date)).alias("latest"), F.avg(in_range(rating)).alias("avg_rating"),
    )


def entity_ratings(df: DataFrame, entity: str, rating: str) -> DataFrame:
    return df.groupBy(entity).agg(
        rows().alias("n_reviews"), F.avg(in_range(rating)).alias("avg_rating"), F.stddev_samp(rating).alias("rating_std")
    )


def rating_bias_by_volume(df: DataFrame, item: str, rating: str) -> DataFrame:
    """Mean and median item rating by how often the item was rated."""
    tiered = entity_ratings(df, item, rating).withColumn("tier", bucket_label("n_reviews", VOLUME_TIERS))
    tiered = stored(tiered.select("tier", "avg_rating", "n_reviews"), "tiers")
    sums = tiered.groupBy("tier").agg(rows().alias("items"), F.avg("avg_rating").alias("mean_item_rating"), F.avg("n_reviews").alias("avg_reviews_per_item"))
    return null_safe_join(sums, grouped_quantiles(tiered, ["tier"], "avg_rating", {"median_item_rating": 0.5}), ["tier"])


def user_tiers(df: DataFrame, user: str, rating: str, tiers) -> DataFrame:
    per_user = entity_ratings(df, user, rating).withColumn("tier", bucket_label("n_reviews", tiers))
    return per_user.groupBy("tier").agg(
        rows().alias("users"), F.avg("n_reviews").alias("avg_reviews_per_user"), F.avg("avg_rating").alias("avg_user_rating")
    )


def top_items(df: DataFrame, item: str, attributes: list[str], rating: str, n: int = 100) -> DataFrame:
    """The ``n`` most reviewed items, ties by id; attributes by their smallest value."""
    return (
        df.groupBy(item)
        .agg(*[F.min(a).alias(a) for a in attributes], rows().alias("n_reviews"), F.avg(in_range(rating)).alias("avg_rating"))
        .orderBy(F.desc("n_reviews"), F.asc(item)).limit(n)
    )


def popular_items(df: DataFrame, item: str, rating: str, min_reviews: int = 50, n: int | None = None) -> DataFrame:
    """Items with enough reviews and the spread of their ratings; with ``n`` only the ``n`` most reviewed."""
    items = entity_ratings(df, item, rating).filter(F.col("n_reviews") >= min_reviews)
    return items if n is None else items.orderBy(F.desc("n_reviews"), F.asc(item)).limit(n)


def power_user_share(df: DataFrame, user: str, p: float = 0.99) -> DataFrame:
    """Threshold at percentile ``p`` of rows per user, the share of rows above it, share of one-row users."""
    dist = count_distribution(df, user)
    cut = dist.agg(F.percentile("n_reviews", F.lit(p), F.col("n_entities"))).scalar()
    n, f = F.col("n_reviews"), F.col("n_entities")
    return dist.agg(
        F.max(cut).alias("threshold"), (F.sum(F.when(n >= cut, n * f).otherwise(0)) * 100.0 / F.sum(n * f)).alias("pct_of_reviews"),
        (F.sum(F.when(n == 1, f).otherwise(0)) * 100.0 / F.sum(f)).alias("pct_one_review_users"),
    )


def length_by(df: DataFrame, keys: list[str], chars: str, words: str) -> DataFrame:
    """Median, mean and p90 of characters and words per key."""

    def side(value: str, name: str) -> DataFrame:
        freq = df.groupBy(*keys, value).agg(rows().alias("f"))
        f = F.col("f")
        return freq.groupBy(*keys).agg(
            F.sum(f).alias(f"n_{name}"), F.percentile(value, F.lit(0.5), f).alias(f"median_{name}"),
            (F.sum(F.col(value) * f) / F.sum(f)).alias(f"mean_{name}"), F.percentile(value, F.lit(0.9), f).alias(f"p90_{name}"),
        )

    return side(chars, "chars").join(side(words, "words"), keys).withColumnRenamed("n_chars", "reviews").drop("n_words")


def duplicate_pairs(df: DataFrame, user: str, item: str) -> DataFrame:
    return df.groupBy(user, item).agg(rows().alias("n")).filter(F.col("n") > 1)


def empirical_cdf(df: DataFrame, value: str) -> DataFrame:
    """Share of rows at or below, and at or above, each distinct value."""
    dist = df.groupBy(value).agg(rows().alias("n"))
    return cdf_of(dist, value, "n")


def cdf_of(dist: DataFrame, value: str, n: str) -> DataFrame:
    """CDF and CCDF of a table of value counts (one row per distinct value)."""
    everything = Window.partitionBy(F.lit(0))
    total, up = F.sum(n).over(everything), F.sum(n).over(everything.orderBy(F.asc(value)))
    return dist.select(value, n, (up / total).alias("cdf"), ((total - up + F.col(n)) / total).alias("ccdf"))


def gini_by(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Gini index of rows per item within each key, and the number of items.

    Items with equal counts are one row of the distribution: ``m`` items of count ``x`` with
    ``before`` smaller ones contribute ``x * (m * before + m (m + 1) / 2)`` to the rank sum.
    """
    dist = df.groupBy(*keys, item).agg(rows().alias("x")).groupBy(*keys, "x").agg(rows().alias("m"))
    w = Window.partitionBy(*keys).orderBy("x")
    m, x = F.col("m"), F.col("x")
    ranked = dist.withColumn("before", F.sum("m").over(w) - m)
    rank_sum = F.sum(x * (m * F.col("before") + m * (m + 1) / 2))
    n, total = F.sum(m), F.sum(x * m)
    return ranked.groupBy(*keys).agg((2 * rank_sum / (n * total) - (n + 1) / n).alias("gini"), n.alias("n_items"))


def sparsity_metrics(df: DataFrame, category: str, user: str, item: str) -> DataFrame:
    """Density, Gini of item counts and share of cold users per category.

    Two passes, one per side of the matrix: the counts per user and per item hold everything,
    distinct numbers included.
    """
    users = df.groupBy(category, user).agg(rows().alias("n")).groupBy(category).agg(
        F.sum("n").alias("n_reviews"), rows().alias("n_users"), F.avg((F.col("n") < 5).cast("double")).alias("cold_ratio")
    )
    both = users.join(gini_by(df, [category], item), category)
    cells = F.col("n_users").cast("double") * F.col("n_items")
    return both.select(category, "n_reviews", "n_users", "n_items", ratio(F.col("n_reviews"), cells).alias("density"), "gini", "cold_ratio")


def sparsity_flags(metrics: DataFrame, low_density: float = 0.005, high_gini: float = 0.60, high_cold: float = 0.50) -> DataFrame:
    """Letters A, B, C for thin, top-heavy and cold categories; ``none`` if no letter applies."""
    letters = F.concat(
        F.when(F.col("density") < low_density, "A").otherwise(""),
        F.when(F.col("gini") > high_gini, "B").otherwise(""),
        F.when(F.col("cold_ratio") > high_cold, "C").otherwise(""),
    )
    return metrics.withColumn("type_flag", F.when(letters == "", "none").otherwise(letters))


def quality_profile(df: DataFrame, rating: str, body: str, helpful: str, total: str, verified: str, min_votes: int = 5) -> DataFrame:
    """One-row review quality profile over all rows."""
    sized = df.withColumn("__len", F.length(body))
    lengths = value_percentiles(sized.filter(F.col("__len").isNotNull()), [], "__len", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99})
    p = {c: lengths.select(c).scalar() for c in ("p25", "p50", "p75", "p99")}
    voted = F.col(total) >= min_votes
    return sized.agg(
        rows().alias("reviews"), *[F.count_if(F.col(rating) == s).alias(f"star_{s}") for s in range(1, 6)],
        *[F.max(c).alias(f"len_{n}") for n, c in p.items()], F.max("__len").alias("len_max"),
        F.count_if(voted).alias("n_voted"), F.avg(F.when(voted, F.col(helpful) / F.col(total))).alias("helpful_ratio"),
        F.count_if(F.col(body).isNull()).alias("null_body"), F.count_if(F.trim(body) == "").alias("empty_body"),
        F.avg(F.col(verified).cast("double")).alias("verified_share"),
    )


def user_stats(df: DataFrame, user: str, label: str, date: str, bridge_from: int = 3, valid_from: int = 5, before_year: int = 2017) -> DataFrame:
    """Rows, distinct labels, bridge flag and valid flag per user, in one aggregation."""
    return df.groupBy(user).agg(
        rows().alias("user_review_count"), F.countDistinct(label).alias("user_genre_count"),
        F.count_if(F.year(date) < before_year).alias("early_reviews"),
    ).select(
        user, "user_review_count", "user_genre_count", (F.col("user_genre_count") >= bridge_from).alias("is_bridge_user"),
        (F.col("early_reviews") >= valid_from).alias("is_valid_user"),
    )


def mean_and_std(df: DataFrame, rating: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(rating).alias("mean"), F.stddev_samp(rating).alias("std"), rows().alias("n"))


def equal_width_histogram(df: DataFrame, value: str, low: float, high: float, bins: int, keys: list[str] | None = None, open_end: bool = False) -> DataFrame:
    """Counts per equal-width bucket (1-based; the last bucket is closed), optionally by further keys.

    With ``open_end`` values above ``high`` are counted in the last bucket; else they are left out.
    """
    bucket = F.least(F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins))
    inside = df.filter(F.col(value) >= low if open_end else F.col(value).between(low, high))
    return inside.groupBy(*(keys or []), bucket.alias("bucket")).agg(rows().alias("n"))


def box_numbers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Minimum, quartiles, maximum and mean per key."""
    kept = stored(df.select(*keys, value), "box")
    sums = kept.groupBy(*keys).agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.avg(value).alias("mean_value"))
    return null_safe_join(sums, grouped_quantiles(kept, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}), keys)
