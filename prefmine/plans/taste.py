"""Topics, genre fingerprints and user taste."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefmine.core import dealt_by_size, stored
from prefmine.functions.text import topic_tokens
from prefmine.models.linalg import sum_vectors
from prefmine.operators.sets import first_per_key

# English stop words of more than two letters (shorter words are dropped anyway).
STOP_WORDS = """
about above after again against ain all and any are aren because been before being below between both but can couldn did didn
does doesn doing don down during each few for from further had hadn has hasn have haven having her here hers herself him
himself his how into isn its itself just mightn more most mustn myself needn nor not now off once only other our ours
ourselves out over own same shan she should shouldn some such than that the their theirs them themselves then there these
they this those through too under until very was wasn were weren what when where which while who whom why will with won
wouldn you your yours yourself yourselves
""".split()


#: Characters of the texts of one task, which holds their words while it counts them.
TASK_CHARS = 4_000_000


def document_tokens(df: DataFrame, key: list[str], text: str, min_tokens: int = 5) -> DataFrame:
    """Topic tokens per document, documents with too few left out. The list is computed once per row.

    Texts are dealt by ``key`` into tasks of about ``TASK_CHARS`` characters, as a few well compressed files may hold all of them.
    """
    texts = dealt_by_size(df.filter(F.col(text).isNotNull()).select(*key, text), key, F.length(text), TASK_CHARS)
    rows = texts.select(*key, F.explode(F.array(topic_tokens(text, STOP_WORDS))).alias("tokens"))
    return rows.filter(F.size("tokens") >= min_tokens)


def vocabulary(bags: DataFrame, n_docs: Column, no_below: int = 20, no_above: float = 0.4, keep: int = 50_000) -> DataFrame:
    """Terms in at least ``no_below`` and at most ``no_above`` of the documents, the ``keep`` most common."""
    return (
        bags.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        .filter((F.col("df") >= no_below) & (F.col("df") <= n_docs * F.lit(no_above)))
        .orderBy(F.desc("df"), "term").limit(keep)
    )


def bags_of_words(docs: DataFrame, key: list[str]) -> DataFrame:
    return docs.select(*key, F.explode("tokens").alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("n"))


def filtered_bags(docs: DataFrame, key: list[str], no_below: int = 20, no_above: float = 0.4, keep: int = 50_000) -> DataFrame:
    """Bag of words over the filtered vocabulary."""
    bags = stored(bags_of_words(docs, key), "bags")
    n = bags.select(*key).distinct().agg(F.count(F.lit(1))).scalar()
    return bags.join(vocabulary(bags, n, no_below, no_above, keep).select("term"), "term", "left_semi")


def mean_vectors(df: DataFrame, key: str, vec: str, dims: int) -> DataFrame:
    """Mean vector per key."""
    sums = sum_vectors(df, key, vec, F.lit(1.0), dims)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    return sums.join(counts, key).select(key, F.transform(vec, lambda x: x / F.col("__n")).alias(vec))


def share_vector(vec: str) -> Column:
    """Vector divided by its sum."""
    total = F.aggregate(vec, F.lit(0.0), lambda s, x: s + x)
    return F.transform(vec, lambda x: x / total)


def fingerprints(items: DataFrame, genre: str, vec: str, dims: int) -> DataFrame:
    """Mean topic vector of each genre (``vec``) and the same as shares (``share``)."""
    return mean_vectors(items, genre, vec, dims).withColumn("share", share_vector(vec))


def discrimination(items: DataFrame, genre: str, vec: str, dims: int) -> DataFrame:
    """Variance of a topic between genres over its mean variance within genres."""
    wide = items.groupBy(genre).agg(
        *[F.avg(F.col(vec)[i]).alias(f"m{i}") for i in range(dims)], *[F.var_samp(F.col(vec)[i]).alias(f"v{i}") for i in range(dims)]
    )
    sums = wide.agg(*[F.var_samp(f"m{i}").alias(f"b{i}") for i in range(dims)], *[F.avg(f"v{i}").alias(f"w{i}") for i in range(dims)])
    entries = ", ".join(f"{i}, b{i} / (w{i} + 1e-9)" for i in range(dims))
    return sums.select(F.expr(f"stack({dims}, {entries}) AS (topic, discrimination)"))


# --------------------------------------------------------------------------- affinity


def first_genre(df: DataFrame, item: str, genre: str, order: list[str]) -> DataFrame:
    """Genre of each item's first row."""
    return first_per_key(df.select(item, genre, *[c for c in order if c not in (item, genre)]), [item], order).select(item, genre)


def affinity(df: DataFrame, user: str, item: str, genre: str, weights: dict[str, Column], bridge: DataFrame, order: list[str], blend: float = 0.2) -> DataFrame:
    """Share of each genre in a user's edge weights, for several weight formulas in one pass.

    Every user gets every genre. Users without weight get equal shares; bridge users
    (``bridge(user, is_bridge_user)``) are blended with equal shares. A user's sums are at most one
    per genre and travel as one row, so the full grid needs no join. Result:
    (variant, user, genre, affinity, is_bridge_user).
    """
    clean = [F.greatest(F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).alias(n) for n, c in weights.items()]
    by_genre = df.select(user, item, *clean).join(first_genre(df, item, genre, order), item)
    sums = by_genre.groupBy(user, genre).agg(*[F.sum(n).alias(n) for n in weights])
    per_user = sums.groupBy(user).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(genre), F.struct(*weights)))).alias("__raw"), *[F.sum(n).alias(f"__t_{n}") for n in weights]
    )
    genres = df.agg(F.array_sort(F.collect_set(genre))).scalar()
    flagged = per_user.join(bridge, user, "left").withColumn("is_bridge_user", F.coalesce("is_bridge_user", F.lit(False)))
    wide = flagged.withColumn(genre, F.explode(genres)).withColumn("__cell", F.try_element_at("__raw", F.col(genre)))
    variants = F.array(*[
        F.struct(F.lit(n).alias("variant"), F.coalesce(F.col("__cell").getField(n), F.lit(0.0)).alias("raw"), F.coalesce(f"__t_{n}", F.lit(0.0)).alias("total"))
        for n in weights
    ])
    long = wide.select(user, genre, "is_bridge_user", F.explode(variants).alias("v"))
    n = F.size(genres)
    share = F.when(F.col("v.total") < 1e-9, 1.0 / n).otherwise(F.try_divide(F.col("v.raw"), F.col("v.total")))
    smooth = F.when(F.col("is_bridge_user"), (1 - blend) * share + blend / n).otherwise(share)
    return long.select(F.col("v.variant").alias("variant"), user, genre, smooth.alias("affinity"), "is_bridge_user")


def entropy_profile(shares: DataFrame, user: str, genre: str) -> DataFrame:
    """Entropy and dominant genre per user and variant."""
    a = F.col("affinity")
    return shares.groupBy("variant", user, "is_bridge_user").agg(
        F.sum(-a * F.ln(a + 1e-9)).alias("entropy"), F.max_by(genre, F.struct(F.round(a, 9), F.col(genre))).alias("dominant")
    )


def simplex_checks(shares: DataFrame, user: str) -> DataFrame:
    """Counts of broken rules: row sums off 1, missing values, values outside [0, 1]; mean entropies."""
    per_user = shares.groupBy("variant", user, "is_bridge_user").agg(
        F.sum("affinity").alias("total"), F.count_if(F.col("affinity").isNull()).alias("missing"), F.min("affinity").alias("low"), F.max("affinity").alias("high"),
        F.sum(-F.col("affinity") * F.ln(F.col("affinity") + 1e-9)).alias("entropy"),
    )
    return per_user.groupBy("variant").agg(
        F.count(F.lit(1)).alias("users"), F.count_if(~F.col("total").between(0.99, 1.01)).alias("bad_sums"), F.sum("missing").alias("missing"),
        F.count_if((F.col("low") < 0) | (F.col("high") > 1 + 1e-9)).alias("out_of_range"),
        F.avg(F.when(F.col("is_bridge_user"), F.col("entropy"))).alias("bridge_entropy"), F.avg(F.when(~F.col("is_bridge_user"), F.col("entropy"))).alias("other_entropy"),
    )


def taste(shares: DataFrame, prints: DataFrame, user: str, genre: str, vec: str, dims: int) -> DataFrame:
    """Topic vector of each user: genre shares times genre fingerprints."""
    rows = shares.join(prints.select(genre, vec), genre)
    return sum_vectors(rows, user, vec, F.col("affinity"), dims)


def taste_profile(shares: DataFrame, prints: DataFrame, user: str, genre: str, vec: str, dims: int) -> DataFrame:
    """Genre shares as a map next to the topic vector."""
    maps = shares.groupBy(user).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(genre, "affinity")))).alias("genres"))
    return maps.join(taste(shares, prints, user, genre, vec, dims), user)


def taste_card(profiles: DataFrame, labels: DataFrame, user: str, vec: str, active: float = 0.01, top: int = 8) -> DataFrame:
    """Top genre, number of active genres, top topic with label, genres and topics in order."""
    entries = F.transform(F.map_entries("genres"), lambda e: F.struct((-F.round(e["value"], 9)).alias("m"), e["key"].alias("k")))
    ordered = F.transform(F.array_sort(entries), lambda s: s["k"])
    topics = F.transform(vec, lambda x, i: F.struct((-F.round(x, 9)).alias("m"), i.alias("t")))
    ranked = F.transform(F.array_sort(topics), lambda s: s["t"])
    card = profiles.select(
        user, ordered.alias("genres_sorted"), F.size(F.filter(F.map_values("genres"), lambda v: v > active)).alias("active_genres"),
        F.slice(ranked, 1, top).alias("top_topics"),
    )
    card = card.withColumn("top_genre", F.get("genres_sorted", F.lit(0))).withColumn("topic", F.get("top_topics", F.lit(0)))
    return card.join(labels, "topic", "left").withColumnRenamed("topic", "top_topic")


def topic_coherence(docs: DataFrame, key: str, top_terms: DataFrame, n_docs: Column) -> DataFrame:
    """Coherence of each topic's terms by document co-occurrence: a document counts as one window."""
    hits = docs.select(key, "term").distinct().join(top_terms, "term")
    joint = (
        hits.alias("a").join(hits.alias("b"), [F.col(f"a.{key}") == F.col(f"b.{key}"), F.col("a.topic") == F.col("b.topic")])
        .groupBy(F.col("a.topic").alias("topic"), F.col("a.term").alias("t1"), F.col("b.term").alias("t2")).agg(F.count(F.lit(1)).alias("n12"))
    )
    return coherence_of(top_terms, joint, n_docs)


def window_coherence(docs: DataFrame, key: str, top_terms: DataFrame, size: int = 110) -> DataFrame:
    """Coherence of each topic's terms by sliding windows of ``size`` tokens, each counted once per term.

    ``docs`` has (key, tokens); a document of at most ``size`` tokens is one window. ``top_terms(topic, term)`` is
    short by definition and comes to the driver. A task marks the windows of its documents that hold each term, a stretch at a time,
    and sends one count per pair of terms. Repeated documents count as often as they occur; no documents give no rows.
    """
    terms = sorted({r["term"] for r in top_terms.select("term").distinct().collect()})
    counts = stored(docs.select("tokens").mapInArrow(lambda batches: _window_counts(batches, terms, size), "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")), "windows")
    named = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    both = counts.filter("i >= 0").select(F.get(named, F.col("i")).alias("t1"), F.get(named, F.col("j")).alias("t2"), F.col("n").alias("n12"))
    both = both.unionByName(both.filter("t1 <> t2").select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), "n12"))
    topics = top_terms.select("topic", F.col("term").alias("t1")).join(top_terms.select("topic", F.col("term").alias("t2")), "topic")
    return coherence_of(top_terms, topics.join(both, ["t1", "t2"]), counts.filter("i < 0").agg(F.sum("n")).scalar())


def _window_counts(batches: Iterator[pa.RecordBatch], terms: list[str], size: int, stretch: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """(i, j, n): windows that hold both of two terms by number, i <= j; (-1, -1, n) is the number of windows."""
    shared, windows, wanted = np.zeros((len(terms), len(terms)), np.int64), 0, pa.array(terms, pa.string())
    for batch in batches:
        tokens = batch.column("tokens")
        numbers = pc.fill_null(pc.index_in(tokens.flatten(), value_set=wanted), -1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        for begin, end in zip(np.concatenate([[0], ends[:-1]]), ends):
            last = max(0, int(end - begin) - size)  # the last window's first token
            windows += last + 1
            at = np.flatnonzero(numbers[begin:end] >= 0)
            here, row = np.unique(numbers[begin + at], return_inverse=True)
            low, high = np.maximum(at - size + 1, 0), np.minimum(at, last)
            for first in range(0, last + 1, stretch):
                stop = min(first + stretch, last + 1)
                some = (high >= first) & (low < stop)
                steps = np.zeros((len(here), stop - first + 1), np.int32)
                np.add.at(steps, (row[some], np.maximum(low[some], first) - first), 1)
                np.add.at(steps, (row[some], np.minimum(high[some] + 1, stop) - first), -1)
                holds = (np.cumsum(steps, 1)[:, :-1] > 0).astype(np.float32)
                shared[np.ix_(here, here)] += np.rint(holds @ holds.T).astype(np.int64)
    i, j = np.nonzero(np.triu(shared))
    columns = [np.append(i, -1).astype(np.int32), np.append(j, -1).astype(np.int32), np.append(shared[i, j], windows)]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "n"])


def coherence_of(top_terms: DataFrame, joint: DataFrame, total: Column) -> DataFrame:
    """Mean cosine of each term's vector with the sum of its topic's vectors; a vector holds the normalised
    pointwise mutual information of the term with the terms of its topic.

    ``joint(topic, t1, t2, n12)`` counts the windows with both terms, ``t1 = t2`` those with one.
    """
    single = joint.filter("t1 = t2").select("topic", F.col("t1").alias("t"), F.col("n12").alias("n1"))
    grid = top_terms.select("topic", F.col("term").alias("t1")).join(top_terms.select("topic", F.col("term").alias("t2")), "topic")
    eps = 1e-12
    p12 = F.coalesce(F.col("n12"), F.lit(0)) / total + eps
    full = (
        grid.join(joint, ["topic", "t1", "t2"], "left")
        .join(single.select("topic", F.col("t").alias("t1"), F.col("n1")), ["topic", "t1"])
        .join(single.select("topic", F.col("t").alias("t2"), F.col("n1").alias("n2")), ["topic", "t2"])
        .withColumn("npmi", F.ln(p12 / (F.col("n1") / total * F.col("n2") / total)) / -F.ln(p12))
    )
    summed = full.groupBy("topic", "t2").agg(F.sum("npmi").alias("s"))
    both = full.join(summed, ["topic", "t2"])
    cos = both.groupBy("topic", "t1").agg(
        F.try_divide(F.sum(F.col("npmi") * F.col("s")), F.sqrt(F.sum(F.col("npmi") * F.col("npmi"))) * F.sqrt(F.sum(F.col("s") * F.col("s")))).alias("c")
    )
    return cos.groupBy("topic").agg(F.avg("c").alias("coherence"))
