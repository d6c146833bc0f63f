"""Column expressions and row-level cleaning steps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmine.core import null_safe_join, value_percentiles

# The product categories that are kept.
KEPT_CATEGORIES = [
    "Wireless", "PC", "Video DVD", "Apparel", "Music", "Health & Personal Care", "Beauty", "Toys", "Sports",
    "Shoes", "Books", "Automotive", "Electronics", "Office Products", "Pet Products", "Grocery", "Outdoors",
    "Camera", "Video Games", "Baby", "Tools",
]

# Upper bounds and labels of the buckets (value <= bound), last one open.
ACTIVITY_BUCKETS = [(1, "new (0-1)"), (4, "cold (2-4)"), (19, "medium (5-19)"), (None, "warm (>=20)")]
USER_TIERS = [(1, "1"), (5, "2–5"), (20, "6–20"), (100, "21–100"), (None, "100+")]
VOLUME_TIERS = [(10, "1–10"), (50, "11–50"), (200, "51–200"), (1000, "201–1000"), (None, "1000+")]


def to_number(column: Column | str, kind: str = "double") -> Column:
    """Number, or null where the text is not one."""
    c = F.col(column) if isinstance(column, str) else column
    return F.trim(c.cast("string")).try_cast(kind)


def iso_date(column: Column | str) -> Column:
    """Date of a ``yyyy-MM-dd`` text; null for any other form and for impossible days."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def any_timestamp(column: Column | str) -> Column:
    """UTC wall-clock timestamp from the three textual forms in use, or null.

    ``Thu Jan 01 00:00:00 -0800 2015``, ``2015-01-01 00:00:00+0000`` and ``2015-01-01 00:00:00``,
    then whatever a plain cast accepts. Spark does not parse week-day names, so they are cut off.
    """
    c = F.col(column) if isinstance(column, str) else column
    zoned = F.coalesce(
        F.try_to_timestamp(F.substring(c, 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy")),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ssZ")),
    )
    return F.coalesce(utc_wall_clock(zoned), c.try_cast("timestamp_ntz"))


def utc_wall_clock(instant: Column) -> Column:
    """Wall-clock time in UTC of an instant, whatever the session's zone and its clock changes."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def flag(column: str) -> Column:
    """1 for ``Y``, 0 for any other text."""
    return (F.col(column) == "Y").cast("int")


def helpful_ratio(helpful: str, total: str) -> Column:
    return F.when(F.col(total) > 0, F.col(helpful) / F.col(total)).otherwise(F.lit(0.0))


def clip(column: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Value held within the bounds; null stays null (``greatest`` and ``least`` would skip it)."""
    c = F.col(column) if isinstance(column, str) else column
    out = c
    if high is not None:
        out = F.when(c > high, F.lit(high)).otherwise(out)
    if low is not None:
        out = F.when(c < low, F.lit(low)).otherwise(out)
    return out


def bucket_label(column: Column | str, tiers: list[tuple[int | None, str]]) -> Column:
    """Label of the first tier whose bound is not exceeded."""
    c = F.col(column) if isinstance(column, str) else column
    out = None
    for bound, label in tiers:
        if bound is None:
            return out.otherwise(F.lit(label))
        test = c <= bound
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out


def count_group(user_count: str, item_count: str) -> Column:
    """``low/mid/high`` label of a user's and an item's history, joined by ``_``."""

    def level(c: str, low: int, mid: int) -> Column:
        return F.when(F.col(c) <= low, "low").when(F.col(c) <= mid, "mid").otherwise("high")

    return F.concat_ws("_", level(user_count, 2, 10), level(item_count, 2, 20))


def calendar_split(ts: str, val_years: tuple[int, ...] = (2016,), test_from: int = 2017, test_to: int | None = 2017) -> Column:
    """``train``, ``val`` or ``test`` by calendar year; years outside the two ranges are ``train``."""
    year = F.year(ts)
    is_test = year >= test_from
    if test_to is not None:
        is_test = is_test & (year <= test_to)
    return F.when(year.isin(*val_years), "val").when(is_test, "test").otherwise("train")


def edge_weights(rating: str, votes: str, tokens: str) -> dict[str, Column]:
    """The five edge-weight formulas by name."""
    share = F.col(rating) / 5.0
    by_votes, by_length = F.log1p(F.col(votes)), F.log1p(F.col(tokens))
    return {
        "f1_rating_votes": share * by_votes,
        "f2_rating_only": share,
        "f3_rating_length": share * by_length,
        "f4_rating_votes_length": share * by_votes * by_length,
        "f5_binary_positive": (F.col(rating) >= 4).cast("double"),
    }


def vote_weight(df: DataFrame, genre: str, votes: str) -> DataFrame:
    """Adds ``vote_cap`` (p99 of the genre, 1 if that is 0) and ``vote_weight`` = log1p of capped votes.

    Votes that are missing, negative or no finite number count as 0, for the cap as for the weight.
    """
    count = F.col(votes).cast("double")
    counted = df.withColumn("__votes", F.when((count > 0) & (count < float("inf")), count).otherwise(0.0))
    caps = value_percentiles(counted, [genre], "__votes", {"__p99": 0.99}).select(
        genre, F.when(F.col("__p99") == 0, 1.0).otherwise(F.col("__p99")).alias("vote_cap")
    )
    weighted = null_safe_join(counted, caps, [genre]).withColumn("vote_weight", F.log1p(F.least("__votes", "vote_cap")))
    return weighted.drop("__votes")


def stabilise(df: DataFrame, weight: str, cap_quantiles) -> DataFrame:
    """Clips ``weight`` to [0, p99] and divides by the maximum after clipping.

    ``cap_quantiles`` is a one-row frame with column ``p99``, from ``exact_quantiles``.
    """
    clean = F.when(F.isnan(weight) | F.col(weight).isNull(), 0.0).otherwise(F.greatest(F.col(weight), F.lit(0.0)))
    cap = cap_quantiles.select("p99").scalar()
    capped = df.withColumn(weight, F.least(clean, cap))
    top = capped.agg(F.max(weight)).scalar()
    return capped.withColumn(weight, F.try_divide(F.col(weight), top))


def slug(column: Column | str, space: str = "_") -> Column:
    """``, `` becomes ``_`` and other spaces become ``space``."""
    c = F.col(column) if isinstance(column, str) else column
    return F.translate(F.replace(c, F.lit(", "), F.lit("_")), " ", space)


def file_slug(column: Column | str) -> Column:
    """Category name as a file name: spaces and slashes become ``_``."""
    c = F.col(column) if isinstance(column, str) else column
    return F.translate(c, " /", "__")


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most frequent non-null values, ties by value."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("__n"))
        .orderBy(F.desc("__n"), F.asc(column))
        .limit(n)
        .select(column)
    )


def collapse_rare(df: DataFrame, column: str, n: int, out: str, other: str = "other") -> DataFrame:
    """Keeps the ``n`` most frequent values and calls every other value, null included, ``other``."""
    kept = top_values(df, column, n).agg(F.collect_set(column)).scalar()
    return df.withColumn(out, F.when(F.array_contains(kept, F.col(column)), F.col(column)).otherwise(F.lit(other)))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with its null and empty-string counts, from a single pass over the data."""
    wide = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(columns)],
        *[F.count_if(F.col(c).cast("string") == "").alias(f"e_{i}") for i, c in enumerate(columns)],
    )
    entries = ", ".join(f"'{c}', n_{i}, e_{i}" for i, c in enumerate(columns))
    long = wide.select(
        "total_rows", F.expr(f"stack({len(columns)}, {entries}) AS (column_name, null_rows, empty_string_rows)")
    )
    return long.select(
        "column_name", "total_rows", "null_rows", "empty_string_rows",
        (F.try_divide(F.col("null_rows"), F.col("total_rows")) * 100).alias("null_pct"),
        (F.try_divide(F.col("empty_string_rows"), F.col("total_rows")) * 100).alias("empty_string_pct"),
    )


def quantile_bucket(df: DataFrame, column: str, labels: list[str], out: str) -> DataFrame:
    """Equal-share buckets with interpolated edges; equal values never split (right-closed)."""
    q = len(labels)
    probs = {f"__q{i}": i / q for i in range(1, q)}
    freq = df.groupBy(column).agg(F.count(F.lit(1)).alias("__freq"))
    edges = freq.agg(F.percentile(column, F.array(*[F.lit(p) for p in probs.values()]), F.col("__freq"))).scalar()
    expr = None
    for i, label in enumerate(labels[:-1]):
        test = F.col(column) <= F.element_at(edges, i + 1)
        expr = F.when(test, label) if expr is None else expr.when(test, label)
    return df.withColumn(out, expr.otherwise(labels[-1]))


def log_edges(maximum: int, points: int = 40) -> list[int]:
    """Distinct integer edges, evenly spaced on a log scale from 1 to ``maximum``."""
    top = math.log10(maximum)
    return sorted({int(10 ** (top * i / (points - 1))) for i in range(points - 1)} | {int(maximum)})


def log_histogram(df: DataFrame, column: str, points: int = 40) -> DataFrame:
    """Counts per log-spaced bucket ``[low, high)``, the last one closed, empty buckets included."""
    edges = log_edges(int(df.agg(F.max(column)).first()[0]), points)
    spans = list(zip(edges[:-1], edges[1:]))
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("__freq"))
    sums = []
    for i, (low, high) in enumerate(spans):
        inside = (F.col(column) >= low) & ((F.col(column) <= high) if i == len(spans) - 1 else (F.col(column) < high))
        sums.append(F.coalesce(F.sum(F.when(inside, F.col("__freq"))), F.lit(0)).alias(f"n{i}"))
    entries = ", ".join(f"{low}L, {high}L, n{i}" for i, (low, high) in enumerate(spans))
    return (
        counted.agg(*sums)
        .select(F.expr(f"stack({len(spans)}, {entries}) AS (low, high, n)"))
        .withColumn("center", F.sqrt(F.col("low") * F.col("high")))
    )
