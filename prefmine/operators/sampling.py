"""Seeded sampling and resampling.

Every draw is a hash of the row's key, so results do not depend on partitioning, and every rank
is computed per (group, hash bucket), so one group that holds most rows is still many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefmine.core import bucketed_rank, bucketed_sum, cut_lineage, explode_range, hash_long, hash_uniform, null_safe_join, ratio, top_per_key
from prefmine.operators.joins import attach_counts

BUCKETS = 4096


def hash_rank(df: DataFrame, group: list[str], keys: list[str], seed: int, name: str = "rank", limit: int | None = None) -> DataFrame:
    """1-based position in a random order of each group, or its first ``limit`` rows."""
    u = hash_uniform(seed, *keys)
    rows = df.withColumn("__u", u)
    return bucketed_rank(rows, group, F.floor(F.col("__u") * BUCKETS), [F.col("__u"), *[F.col(k) for k in keys]], name, limit).drop("__u")


def bernoulli(df: DataFrame, keys: list[str], share: float, seed: int) -> DataFrame:
    return df.filter(hash_uniform(seed, *keys) < share)


def fixed_size(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows, or all if there are fewer."""
    return hash_rank(df, [], keys, seed, "__r", n).drop("__r")


def stratified_fraction(df: DataFrame, category: str, keys: list[str], cap: int, seed: int) -> DataFrame:
    """Each category thinned to about ``cap`` rows, each row kept with probability cap / n."""
    counted = attach_counts(df, [category], "__n")
    return counted.filter(hash_uniform(seed, *keys) < F.lit(float(cap)) / F.col("__n")).drop("__n")


def stratified_cap(df: DataFrame, category: str, keys: list[str], cap: int, seed: int) -> DataFrame:
    """At most ``cap`` random rows per category, exactly."""
    return hash_rank(df, [category], keys, seed, "__r", cap).drop("__r")


def weighted_sample(df: DataFrame, group: str, weight: Column, keys: list[str], n: int, seed: int) -> DataFrame:
    """``n`` rows per group without replacement, heavier rows first to be drawn.

    The exponential key -ln(u)/w turns the draw into a top-n; buckets are fine steps of
    its logarithm, and those that cannot reach the first ``n`` are dropped before the sort.
    """
    u = hash_uniform(seed, *keys) + F.lit(2.0**-49)
    rows = df.withColumn("__key", -F.ln(u) / weight)
    ranked = bucketed_rank(rows, [group], F.floor(F.log2("__key") * 64), [F.col("__key"), *[F.col(k) for k in keys]], "__r", n)
    return ranked.drop("__r", "__key")


# --------------------------------------------------------------------------- resampling by sparsity type


def oversample_target(n: Column, total: Column) -> Column:
    """Rows a thin category grows to: more growth the fewer rows it has."""
    return F.greatest(n, F.floor(n * (1 + 5.0 * (1.0 / F.log1p(n)) / F.log1p(total))))


def oversample(df: DataFrame, category: str, keys: list[str], total: Column, seed: int = 42, copy: str = "copy_id") -> DataFrame:
    """Type A: every row once, plus rows drawn with replacement up to the target of the category.

    ``copy`` tells copies of a row apart and is part of the key of later draws.
    """
    sizes = df.groupBy(category).agg(F.count(F.lit(1)).alias("__n"))
    extra = sizes.withColumn("__extra", oversample_target(F.col("__n"), total) - F.col("__n"))
    draws = explode_range(extra, F.col("__extra"), "__draw").withColumn(
        "__idx", F.floor(hash_uniform(seed + 1, category, "__draw") * F.col("__n")) + 1
    ).select(category, "__draw", "__idx")
    indexed = hash_rank(df, [category], [*keys, copy], seed, "__idx")
    drawn = null_safe_join(draws, indexed, [category, "__idx"], "inner").withColumn(
        copy, F.concat_ws(".", copy, F.concat(F.lit("a"), F.col("__draw").cast("string")))
    )
    return df.unionByName(drawn.select(*df.columns))


def popularity_inverse(df: DataFrame, category: str, item: str, keys: list[str], seed: int = 42, copy: str = "copy_id") -> DataFrame:
    """Type B: as many rows per category as before, drawn with weight 1/sqrt(rows of the item).

    Systematic resampling: ``n`` evenly spaced points with one random offset fall on a line on
    which each item has length sqrt(rows). Whole numbers keep the segments exactly adjacent, so
    each category keeps its size exactly. An item's draws are spread evenly over its rows.
    """
    items = df.groupBy(category, item).agg(F.count(F.lit(1)).alias("__c"))
    items = items.withColumn("__mass", F.floor(F.sqrt("__c") * 1024)).withColumn("__u", hash_uniform(seed + 2, category, item))
    line = bucketed_sum(items, [category], F.floor(F.col("__u") * BUCKETS), [F.col("__u"), F.col(item)], F.col("__mass"), "__end")
    totals = items.groupBy(category).agg(F.sum("__mass").alias("__w"), F.sum("__c").alias("__n"))
    line = null_safe_join(line, totals, [category]).withColumn("__offset", hash_uniform(seed + 3, category))

    def points_below(x: Column) -> Column:
        return F.ceil(x * F.col("__n") / F.col("__w") - F.col("__offset"))

    line = line.withColumn("__m", points_below(F.col("__end")) - points_below(F.col("__end") - F.col("__mass")))
    ranked = hash_rank(df, [category, item], [*keys, copy], seed + 4, "__r")
    rows = null_safe_join(ranked, line.select(category, item, "__c", "__m"), [category, item], "inner")
    r, c, m = F.col("__r"), F.col("__c"), F.col("__m")
    copies = F.floor(r * m / c) - F.floor((r - 1) * m / c)
    repeated = rows.withColumn("__copies", copies).filter("__copies >= 1").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return repeated.withColumn(copy, F.concat_ws(".", copy, F.concat(F.lit("b"), F.col("__k").cast("string")))).select(*df.columns)


def repeat_cold_users(df: DataFrame, category: str, user: str, times: int = 3, threshold: int = 5, copy: str = "copy_id") -> DataFrame:
    """Type C: rows of users with fewer than ``threshold`` rows in the category appear ``times`` times."""
    counted = attach_counts(df, [category, user], "__n")
    copies = F.when(F.col("__n") < threshold, times).otherwise(1)
    return (
        counted.withColumn("__k", F.explode(F.sequence(F.lit(1), copies)))
        .withColumn(copy, F.when(F.col("__k") > 1, F.concat_ws(".", copy, F.concat(F.lit("c"), F.col("__k").cast("string")))).otherwise(F.col(copy)))
        .select(*df.columns)
    )


def resample(df: DataFrame, flags: DataFrame, category: str, user: str, item: str, keys: list[str], seed: int = 42) -> DataFrame:
    """Steps A, B and C in this order for the categories whose flag has the letter.

    A and B read their input several times, so it is written out before each step.
    """
    rows = cut_lineage(df.withColumn("copy_id", F.lit("0")).join(flags.select(category, "type_flag"), category))
    total = F.lit(rows.count())

    def where(letter: str):
        return rows.filter(F.col("type_flag").contains(letter)), rows.filter(~F.col("type_flag").contains(letter))

    hit, rest = where("A")
    rows = cut_lineage(oversample(hit, category, keys, total, seed).unionByName(rest))
    hit, rest = where("B")
    rows = cut_lineage(popularity_inverse(hit, category, item, keys, seed).unionByName(rest))
    hit, rest = where("C")
    return repeat_cold_users(hit, category, user).unionByName(rest)


def resample_log(before: DataFrame, after: DataFrame, category: str) -> DataFrame:
    """Rows before and after per category and their ratio to three places."""
    b = before.groupBy(category).agg(F.count(F.lit(1)).alias("n_before"))
    a = after.groupBy(category, "type_flag").agg(F.count(F.lit(1)).alias("n_after"))
    return b.join(a, category).withColumn("ratio", F.round(ratio(F.col("n_after"), F.col("n_before")), 3))


# --------------------------------------------------------------------------- users, holdouts, negatives


def sample_users(df: DataFrame, user: str, n: int, seed: int) -> DataFrame:
    """All rows of ``n`` random users."""
    chosen = fixed_size(df.select(user).distinct(), [user], n, seed)
    return df.join(chosen, user, "left_semi")


def leave_one_out(
    df: DataFrame, user: str, stage: str, keys: list[str], n_val: int, n_test: int, final: int = 3, min_final: int = 3, seed: int = 42
) -> DataFrame:
    """Adds ``split``: one random final-stage row of each held-out user is ``val`` or ``test``.

    Users with at least ``min_final`` final-stage rows are put in random order; the first go to
    val (at most half of them), the next to test.
    """
    finals = df.filter(F.col(stage) == final)
    eligible = finals.groupBy(user).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_final)
    size = eligible.agg(F.count(F.lit(1))).scalar()
    val_size = F.least(F.lit(n_val), F.floor(size / 2))
    ordered = hash_rank(eligible.select(user), [], [user], seed, "__r")
    side = F.when(F.col("__r") <= val_size, "val").when(F.col("__r") <= val_size + n_test, "test")
    users = ordered.withColumn("__side", side).filter(F.col("__side").isNotNull()).select(user, "__side")
    picked = top_per_key(finals.withColumn("__u", hash_uniform(seed + 1, *keys)), [user], [F.col("__u"), *[F.col(k) for k in keys]])
    held = picked.select(user, *[k for k in keys if k != user]).join(users, user)
    return df.join(held, list(dict.fromkeys([user, *keys])), "left").withColumn("split", F.coalesce("__side", F.lit("train"))).drop("__side")


def next_prime(n: int) -> int:
    candidate = max(n, 2)
    while any(candidate % d == 0 for d in range(2, int(candidate**0.5) + 1)):
        candidate += 1
    return candidate


WALK = 10_000  # steps of a walk that are one row


def _inverse(b: Column, p: int) -> Column:
    """The x with ``b x = 1`` modulo the prime ``p``: b to the power p - 2, bit by bit."""
    bits = F.array(*[F.lit(bit == "1") for bit in f"{p - 2:b}"])
    return F.aggregate(bits, F.lit(1).cast("bigint"), lambda acc, bit: F.when(bit, acc * acc % p * b % p).otherwise(acc * acc % p))


def unseen_walk(wants: DataFrame, items: DataFrame, seen: DataFrame, user: str, item: str, seed: int) -> DataFrame:
    """The first ``want`` unseen items of each user in random order, or all where the catalogue has fewer.

    ``wants(user, want)`` has one row per user and ``items(item, idx)`` is a dense index. Each user
    walks through the catalogue in an order of its own, ``(a + b j) mod p`` with p prime, which
    never repeats an item. A user with s seen items needs at most want + s steps, so nobody falls
    short while unseen items are left, and no draw has to be repeated.

    Steps are not shuffled: the step at which a user meets a seen item is worked out from the item, so
    what meets are lists of steps, one row per user and ``WALK`` steps, and only free steps become rows.
    """
    size = items.count()
    p = next_prime(size)
    pairs = seen.select(user, item).distinct()
    load = pairs.groupBy(user).agg(F.count(F.lit(1)).alias("__s"))
    walk = wants.join(load, user, "left").withColumn(
        "__steps", F.least(F.lit(p), F.coalesce("__s", F.lit(0)) + F.col("want") + (p - size))
    )
    walk = walk.withColumn("__a", hash_long(seed, user) % p).withColumn("__b", 1 + hash_long(seed + 1, user) % max(p - 1, 1))
    walk = cut_lineage(walk.select(user, "want", "__steps", "__a", "__b").filter("__steps >= 1"))
    met = pairs.join(items.select("idx", item), item).join(walk.select(user, "__steps", "__a", _inverse(F.col("__b"), p).alias("__inv")), user)
    met = met.withColumn("__at", F.pmod(F.pmod(F.col("idx") - F.col("__a"), F.lit(p)) * F.col("__inv"), F.lit(p))).filter("__at < __steps")
    met = met.groupBy(user, F.floor(F.col("__at") / WALK).alias("__chunk")).agg(F.collect_list((F.col("__at") % WALK).cast("int")).alias("__met"))
    chunks = walk.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__steps") - 1) / WALK))))
    chunks = chunks.join(met, [user, "__chunk"], "left")
    idx = (F.col("__a") + F.col("__b") * F.col("__step")) % p
    last = (F.least(F.col("__steps") - F.col("__chunk") * WALK, F.lit(WALK)) - 1).cast("int")
    free = F.array_except(F.sequence(F.lit(0), last), F.coalesce("__met", F.array().cast("array<int>")))
    free = F.filter(free, lambda j: (F.col("__a") + F.col("__b") * (F.col("__chunk") * WALK + j)) % p < size)
    # no more than wanted goes on, and of later rows only what earlier ones lack
    chunks = chunks.select(user, "want", "__a", "__b", "__chunk", F.slice(free, F.lit(1), F.col("want").cast("int")).alias("__free"))
    before = Window.partitionBy(user).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    missing = F.greatest(F.col("want") - F.coalesce(F.sum(F.size("__free")).over(before), F.lit(0)), F.lit(0)).cast("int")
    chunks = chunks.withColumn("__missing", missing)
    steps = chunks.select(user, "want", "__a", "__b", "__chunk", F.explode(F.slice("__free", F.lit(1), F.col("__missing"))).alias("__j"))
    steps = steps.withColumn("__step", F.col("__chunk") * WALK + F.col("__j")).select(user, "want", (F.col("__step") + 1).alias("draw"), idx.alias("idx"))
    return steps.join(items.select("idx", item), "idx").select(user, item, "draw", "want")


def sample_negatives(users: DataFrame, items: DataFrame, seen: DataFrame, user: str, item: str, n: int, seed: int) -> DataFrame:
    """``n`` distinct items per user that ``seen(user, item)`` does not have, uniformly at random."""
    wants = users.select(user).distinct().withColumn("want", F.lit(n))
    return unseen_walk(wants, items, seen, user, item, seed).select(user, item, "draw")


def training_negatives(positives: DataFrame, items: DataFrame, seen: DataFrame, user: str, item: str, stage: str, keys: list[str], seed: int) -> DataFrame:
    """One unseen item per positive row, with the stage of the positive.

    A user's k-th positive takes the k-th unseen item of the user's walk, starting over where
    the user has more positives than unseen items. Users who have seen everything drop out.
    """
    wants = positives.groupBy(user).agg(F.count(F.lit(1)).alias("want"))
    walk = unseen_walk(wants, items, seen, user, item, seed)
    free = bucketed_rank(walk, [user], F.floor(F.col("draw") / 1000), [F.col("draw")], "__k").filter(F.col("__k") <= F.col("want"))
    sizes = free.groupBy(user).agg(F.count(F.lit(1)).alias("__m"))
    numbered = hash_rank(positives, [user], keys, seed + 7, "__r").join(sizes, user)
    numbered = numbered.withColumn("__k", (F.col("__r") - 1) % F.col("__m") + 1)
    return numbered.join(free.select(user, F.col(item).alias("negative"), "__k"), [user, "__k"]).select(user, *[k for k in keys if k != user], "negative", stage)


def shuffled(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Rows in a random order that does not depend on their partitions."""
    return df.withColumn("__u", hash_uniform(seed, *keys)).orderBy("__u", *keys).drop("__u")
