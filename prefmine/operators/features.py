"""Item and user features as sparse tables (id, feature, value) and dense ones (id, vec)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmine.core import bucketed_rank, cut_lineage, grouped_quantiles, stored
from prefmine.functions.scalars import collapse_rare
from prefmine.functions.text import word_tokens
from prefmine.models.linalg import sum_vectors, unit
from prefmine.operators.dedup import previous_in_order
from prefmine.operators.sets import first_per_key


def item_texts(df: DataFrame, item: str, bucket: Column, order: list[str], text: str, max_rows: int = 10_000) -> DataFrame:
    """The texts of an item joined by blanks in order, in numbered parts of at most ``max_rows`` texts.

    Nothing is dropped: an item with more texts has more parts, so no single value outgrows a row.
    """
    rows = df.filter(F.col(text).isNotNull()).select(item, *order, text)
    placed = bucketed_rank(rows, [item], bucket, [F.col(c) for c in order], "__pos")
    placed = placed.withColumn("part", F.floor((F.col("__pos") - 1) / max_rows).cast("int"))
    joined = placed.groupBy(item, "part").agg(F.array_sort(F.collect_list(F.struct("__pos", F.col(text).alias("t")))).alias("__all"))
    return joined.select(item, "part", F.concat_ws(" ", F.transform("__all", lambda s: s["t"])).alias("text"))


def term_rows(df: DataFrame, item: str, text: str, bigrams: bool = True, order: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """One row (item, term) per occurrence in the texts of an item, as if they were joined by blanks.

    Texts are never joined. Two-word terms that span two neighbouring texts are added from the
    first and last word of each text. Exploding the one-element array keeps the word list as a
    value, so that it is computed once per row however often it is used.
    """
    texts = df.filter(F.col(text).isNotNull()).select(item, *(order or []), text)
    rows = texts.select(item, *(order or []), F.explode(F.array(word_tokens(text))).alias("__t"))
    rows = rows.filter(F.size("__t") > 0)
    terms = F.col("__t")
    if bigrams:
        last = F.size("__t") - 1
        terms = F.concat(terms, F.zip_with(F.slice("__t", 1, last), F.slice("__t", 2, last), lambda x, y: F.concat_ws(" ", x, y)))
    counted = rows.select(item, F.explode(terms).alias("term"))
    if bigrams and order:
        ends = cut_lineage(rows.select(item, *order, F.get("__t", F.lit(0)).alias("__first"), F.element_at("__t", -1).alias("__lastw")))
        linked = previous_in_order(ends, [item], bucket, order, {"__before": "__lastw"}).filter(F.col("__before").isNotNull())
        counted = counted.unionByName(linked.select(item, F.concat_ws(" ", "__before", "__first").alias("term")))
    return counted


def term_counts(df: DataFrame, item: str, text: str, bigrams: bool = True, order: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """Counts per (item, term) of :func:`term_rows`."""
    return term_rows(df, item, text, bigrams, order, bucket).groupBy(item, "term").agg(F.count(F.lit(1)).alias("tf"))


def admitted_terms(
    terms: DataFrame, item: str, n_items: Column, min_df: int, max_df: float, max_features: int, at_first: int = 4
) -> tuple[DataFrame, DataFrame]:
    """(counts per item and term, vocabulary) of the ``max_features`` most frequent terms in ``min_df`` to ``max_df`` of the items.

    Only numbers are shuffled for all terms: how often each hash of a term occurs. Terms are counted by item where their hash is among the most
    frequent, ``at_first`` times as many as wanted. A term that is left out occurs less often than any of these; more are counted
    until enough terms that occur as often are admitted, or none is left.
    """
    coded = terms.withColumn("__code", F.xxhash64("term"))
    totals = coded.groupBy("__code").agg(F.count(F.lit(1)).alias("__total"))
    totals = stored(totals.filter(F.col("__total") >= min_df), "totals")
    tried = at_first * max_features
    while True:
        found, least = totals.orderBy(F.desc("__total")).limit(tried).agg(F.count(F.lit(1)), F.min("__total")).first()
        if found < tried:
            least = min_df
        codes = stored(totals.filter(F.col("__total") >= least).select("__code"), "codes")
        counts = stored(coded.join(codes, "__code", "left_semi").groupBy(item, "term").agg(F.count(F.lit(1)).alias("tf")), "counts")
        vocab = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
        vocab = vocab.filter((F.col("df") >= min_df) & (F.col("df") <= n_items * F.lit(max_df))).orderBy(F.desc("total"), "term").limit(max_features)
        vocab = stored(vocab, "vocabulary")
        if found < tried or vocab.filter(F.col("total") >= least).count() >= max_features:
            return counts, vocab
        tried *= 8


def tf_idf(terms: DataFrame, item: str, n_items: Column, min_df: int, max_df: float, max_features: int) -> DataFrame:
    """Sublinear tf times smoothed idf, rows of length 1, over the most frequent admitted terms.

    ``terms`` has a row per occurrence (:func:`term_rows`). Weights and lengths read the stored counts, not the texts.
    """
    counts, vocab = admitted_terms(terms, item, n_items, min_df, max_df, max_features)
    vocab = vocab.withColumn("idf", F.ln((1 + n_items) / (1 + F.col("df"))) + 1)
    weighted = counts.join(vocab.select("term", "idf"), "term").withColumn("value", (1 + F.ln("tf")) * F.col("idf"))
    lengths = weighted.groupBy(item).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("__len"))
    return weighted.join(lengths, item).select(item, F.col("term").alias("feature"), (F.col("value") / F.col("__len")).alias("value"))


def item_attributes(df: DataFrame, item: str, rating: str, price: str, brand: str, order: list[str], *more: Column) -> DataFrame:
    """Mean rating, count, and the first non-null price and brand in order; ``more`` aggregates come from the same pass."""
    at = F.struct(*order)
    return df.groupBy(item).agg(
        F.avg(rating).alias("avg_rating"), F.count(rating).alias("n_reviews"),
        F.min_by(price, F.when(F.col(price).isNotNull(), at)).alias("price"), F.min_by(brand, F.when(F.col(brand).isNotNull(), at)).alias("brand"),
        *more,
    )


def numeric_features(attributes: DataFrame, item: str) -> DataFrame:
    """Price (missing: median) and rating divided by their means, log of the count.

    The attributes are read five times, so they are written once.
    """
    attributes = stored(attributes.select(item, "price", "avg_rating", "n_reviews"), "attributes")
    median = grouped_quantiles(attributes, [], "price", {"m": 0.5}).scalar()
    rows = attributes.withColumn("__p", F.coalesce("price", median)).withColumn("__r", F.coalesce("avg_rating", F.lit(3.5)))
    means = rows.agg(F.greatest(F.avg("__p"), F.lit(1e-6)).alias("p"), F.greatest(F.avg("__r"), F.lit(1e-6)).alias("r"))
    return rows.select(
        item, (F.col("__p") / means.select("p").scalar()).alias("price_scaled"), (F.col("__r") / means.select("r").scalar()).alias("rating_scaled"),
        F.log1p("n_reviews").alias("log_count"),
    )


def brand_features(attributes: DataFrame, item: str, n: int = 100) -> DataFrame:
    """One-hot brand, the frequent ones by name and the rest as ``other``."""
    labelled = collapse_rare(attributes, "brand", n, "__b")
    return labelled.select(item, F.concat(F.lit("brand_"), F.col("__b")).alias("feature"), F.lit(1.0).alias("value"))


def melt(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Wide numeric columns as a sparse table."""
    entries = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    return df.select(key, F.expr(f"stack({len(columns)}, {entries}) AS (feature, value)"))


def stack_features(blocks: dict[str, DataFrame], item: str) -> DataFrame:
    """Blocks side by side: feature names get the block's name as a prefix."""
    out = None
    for name, block in blocks.items():
        part = block.select(item, F.concat(F.lit(f"{name}:"), F.col("feature")).alias("feature"), "value")
        out = part if out is None else out.unionByName(part)
    return out


# --------------------------------------------------------------------------- matrices


def utility_matrix(df: DataFrame, user: str, item: str, rating: str, repeated: str = "sum") -> DataFrame:
    """One row per (user, item); repeated ratings are added up, or averaged with ``repeated='avg'``."""
    agg = {"sum": F.sum, "avg": F.avg}[repeated](F.col(rating).cast("double"))
    return df.groupBy(user, item).agg(agg.alias("value"))


def implicit_matrix(df: DataFrame, user: str, item: str) -> DataFrame:
    return df.groupBy(user, item).agg(F.count(F.lit(1)).cast("double").alias("value"))


def user_centred(matrix: DataFrame, user: str) -> DataFrame:
    """Values minus the user's mean over stored cells, which is kept as ``user_mean``."""
    means = matrix.groupBy(user).agg(F.avg("value").alias("user_mean"))
    return matrix.join(means, user).withColumn("centred", F.col("value") - F.col("user_mean"))


def double_centred(matrix: DataFrame, user: str, item: str) -> DataFrame:
    """Minus the user's mean, then minus the item's mean of what is left."""
    rows = cut_lineage(user_centred(matrix, user))
    means = rows.groupBy(item).agg(F.avg("centred").alias("item_mean"))
    return rows.join(means, item).withColumn("centred", F.col("centred") - F.col("item_mean"))


def decayed_profile(df: DataFrame, vectors: DataFrame, user: str, item: str, rating: str, ts: str, dims: int, rate: float = 0.001) -> DataFrame:
    """Sum of item vectors weighted by centred rating and age, as unit vectors."""
    latest = df.agg(F.max(ts)).scalar()
    cells = utility_matrix(df, user, item, rating)
    means = cells.groupBy(user).agg(F.avg("value").alias("__mean"))
    days = F.timestamp_diff("DAY", F.col(ts), latest)
    weight = (F.col(rating) - F.col("__mean")) * F.exp(-rate * days)
    rows = df.join(means, user).join(vectors, item)
    sums = sum_vectors(rows.withColumn("__wt", weight), user, "vec", F.col("__wt"), dims)
    return sums.withColumn("vec", unit(F.col("vec")))


def mean_profile(df: DataFrame, vectors: DataFrame, user: str, item: str, dims: int) -> DataFrame:
    """Average of the vectors of a user's items, as unit vectors."""
    sums = sum_vectors(df.select(user, item).join(vectors, item), user, "vec", F.lit(1.0), dims)
    return sums.withColumn("vec", unit(F.col("vec")))


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column on [0, 1]; a constant column becomes 0."""
    bounds = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    for c in columns:
        lo, hi = bounds.select(f"lo_{c}").scalar(), bounds.select(f"hi_{c}").scalar()
        df = df.withColumn(f"{c}_scaled", F.coalesce(F.try_divide((F.col(c) - lo).cast("double"), (hi - lo).cast("double")), F.lit(0.0)))
    return df


# Names and order of the residual meta features.
META_FEATURES = [
    "b_minus_base", "c_minus_base", "d_minus_base", "a_minus_base", "abs_b_minus_base", "abs_c_minus_base",
    "abs_d_minus_base", "abs_a_minus_base", "prediction_mean", "prediction_std", "prediction_range", "base",
]


def residual_meta(df: DataFrame, base: str = "base", models: tuple[str, ...] = ("a", "b", "c", "d")) -> DataFrame:
    """Deviations of four predictions from the base, and mean, population spread and range of the four."""
    p = {m: F.col(m) for m in models}
    mean = sum(p.values()) / len(p)
    spread = F.sqrt(sum((c - mean) * (c - mean) for c in p.values()) / len(p))
    out = {f"{m}_minus_base": p[m] - F.col(base) for m in models} | {f"abs_{m}_minus_base": F.abs(p[m] - F.col(base)) for m in models}
    out |= {"prediction_mean": mean, "prediction_std": spread, "prediction_range": F.greatest(*p.values()) - F.least(*p.values())}
    return df.select("*", *[out[n].alias(n) for n in META_FEATURES if n != "base"])


def first_meta(df: DataFrame, item: str, order: list[str], columns: list[str]) -> DataFrame:
    """Title-like columns of an item's first row, joined by blanks."""
    first = first_per_key(df.select(item, *[c for c in dict.fromkeys([*order, *columns]) if c != item]), [item], order)
    return first.select(item, F.trim(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])).alias("meta_text"))
