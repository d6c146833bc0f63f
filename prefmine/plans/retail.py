"""Retail reviews: from raw text columns to clean, capped and partitioned rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefmine.core import value_percentiles
from prefmine.functions import scalars as S
from prefmine.operators.joins import active_only
from prefmine.operators.sampling import stratified_fraction
from prefmine.operators.sets import first_per_key
from prefmine.sources.sinks import write_partitioned

# Output columns before the derived ones.
CLEAN_COLUMNS = [
    "review_id", "customer_id", "product_id", "product_parent", "product_title", "product_category", "star_rating", "helpful_votes",
    "total_votes", "vine", "verified_purchase", "review_headline", "review_body", "review_date",
]


def typed(raw: DataFrame) -> DataFrame:
    """Rows with a well-formed date; counts and stars as numbers."""
    numbers = {c: S.to_number(c, "int") for c in ("star_rating", "helpful_votes", "total_votes")}
    text = F.col("review_date").cast("string")
    return raw.filter(text.rlike(r"^\d{4}-\d{2}-\d{2}$")).withColumns({**numbers, "review_date": S.iso_date(text)})


def clean(raw: DataFrame, categories: list[str] = S.KEPT_CATEGORIES, tie_order: list[str] | None = None) -> DataFrame:
    """One row per review id of a kept category with a body, flags as numbers, derived ratio and length.

    Of several rows with one id the first in ``tie_order`` stays. Filters on columns that decide
    nothing about duplicates are left to the optimiser to push down.
    """
    rows = first_per_key(typed(raw), ["review_id"], tie_order or ["review_date", "customer_id", "product_id"])
    rows = rows.withColumns({"vine": S.flag("vine"), "verified_purchase": S.flag("verified_purchase")}).select(*CLEAN_COLUMNS)
    rows = rows.filter(F.col("product_category").isin(categories) & F.col("review_body").isNotNull())
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("helpful_votes", "total_votes")})
    return rows.withColumns({"helpful_ratio": S.helpful_ratio("helpful_votes", "total_votes"), "review_length": F.length("review_body")})


def balanced(rows: DataFrame, cap: int = 3_000_000, seed: int = 42) -> DataFrame:
    """Every category thinned to about ``cap`` rows."""
    return stratified_fraction(rows, "product_category", ["review_id"], cap, seed)


def without_outliers(rows: DataFrame, min_user: int = 5, min_item: int = 10, low: int = 10, p: float = 0.99) -> DataFrame:
    """Active users and items, review length from ``low`` to the percentile ``p`` of all rows."""
    cap = value_percentiles(rows, [], "review_length", {"cap": p}).scalar()
    kept = active_only(rows, "customer_id", "product_id", min_user, min_item)
    return kept.filter((F.col("review_length") >= low) & (F.col("review_length") <= cap))


def write_clean(rows: DataFrame, path: str) -> None:
    write_partitioned(rows, path, "product_category")
