"""Book reviews: unified rows to weighted, labelled rows and a sample for topic models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefmine.core import stored
from prefmine.functions import scalars as S
from prefmine.functions.text import normalise_text, word_count
from prefmine.operators.profiles import user_stats
from prefmine.operators.sampling import weighted_sample
from prefmine.sources.schemas import timestamp_of

NUMERIC = ["rating", "n_votes", "n_comments", "publication_year", "num_pages"]


def prepared(
    unified: DataFrame, val_years: tuple[int, ...] = (2016,), test_from: int = 2017, test_to: int | None = 2017,
    bridge_from: int = 3, valid_from: int = 5, before_year: int = 2017, min_tokens: int = 10,
) -> DataFrame:
    """Typed and cleaned reviews of valid users with vote and edge weights, user statistics and split.

    User statistics are taken over all input rows, vote caps over the rows that are kept, which are written once: caps and
    weights read them. Exploding one-element arrays keeps texts and counts as values, computed once per row.
    """
    dated = unified.withColumn("date_added", timestamp_of(unified, "date_added"))
    stats = user_stats(dated, "user_id", "primary_genre", "date_added", bridge_from, valid_from, before_year)
    rows = dated.withColumns({c: S.to_number(c) for c in NUMERIC if c in unified.columns})
    rows = rows.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ("n_votes", "n_comments") if c in unified.columns})
    rows = rows.filter((F.col("rating") > 0) & F.col("review_text").isNotNull() & F.col("date_added").isNotNull())
    rows = normalise_text(rows, "review_text")
    rows = rows.withColumn("review_text", F.explode(F.array("review_text"))).withColumn("review_token_count", F.explode(F.array(word_count("review_text"))))
    rows = stored(rows.filter(F.col("review_token_count") >= min_tokens), "prepared")
    rows = S.vote_weight(rows, "primary_genre", "n_votes")
    rows = rows.withColumn("edge_weight", F.col("vote_weight") * F.col("rating") / 5.0).drop("vote_cap")
    rows = rows.join(stats.filter("is_valid_user").drop("is_valid_user"), "user_id")
    return rows.withColumn("split", S.calendar_split("date_added", val_years, test_from, test_to))


def topic_sample(rows: DataFrame, per_genre: int = 200_000, seed: int = 42) -> DataFrame:
    """Training reviews for topic models, up to ``per_genre`` per genre, drawn by vote weight."""
    train = rows.filter("split = 'train'")
    picked = weighted_sample(train, "primary_genre", F.col("vote_weight") + 1e-6, ["review_id"], per_genre, seed)
    return picked.select("review_id", "user_id", "book_id", "primary_genre", "rating", "review_text", "vote_weight", "edge_weight")
