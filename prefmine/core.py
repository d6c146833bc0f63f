"""Session, shared storage and skew-safe building blocks used by every other module.

Nothing here, or in the modules that use it, collects a table to the driver. What the driver
may hold is fixed in size: a cut point, a model's coefficients, one row of statistics.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def get_session(app: str = "prefmine", cores: str = "*", **conf: str) -> SparkSession:
    """Local session for tests and benches; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# --------------------------------------------------------------------------- shared storage


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session may run without the setting; it then gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="prefmine-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage, so lost executors never replay a whole loop."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    Like :func:`cut_lineage` it survives lost executors, but later steps read only the columns they need.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, path: str, schema: str, make: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """The table at ``path``, written from ``make()`` unless an earlier run has completed it.

    So a job whose driver was lost goes on after its last complete table when it is started again with the same paths.
    """
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").partitionBy(*by).parquet(path)
    return spark.read.schema(schema).parquet(path)


def dealt_by_size(df: DataFrame, keys: list[str], size: Column, per_task: int) -> DataFrame:
    """Rows dealt by key into tasks that hold about ``per_task`` of the total ``size``, whatever the number of input files.

    The total takes one pass of its own. Rows that fit one task stay as they are. A later aggregation by the keys and more needs no further shuffle.
    """
    total = df.agg(F.sum(size)).first()[0] or 0
    tasks = -(-int(total) // per_task)
    return df.repartition(tasks, *keys) if tasks > 1 else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for an intermediate table."""
    return f"{shared_dir(spark).rstrip('/')}/prefmine/{name}-{uuid.uuid4().hex}"


# --------------------------------------------------------------------------- expressions


def rnd(column: Column | str, digits: int = 6) -> Column:
    return F.round(column, digits)


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, null when the denominator is zero."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def pct(condition: Column) -> Column:
    """Share of rows, in percent, for which ``condition`` holds."""
    return F.count_if(condition) * 100.0 / F.count(F.lit(1))


def hash_uniform(seed: int, *keys: Column | str) -> Column:
    """Uniform number in [0, 1) that depends on the row's key and the seed only.

    ``rand()`` depends on how rows are partitioned; this does not, so a retried or re-planned
    task draws the same number. 48 bits of MD5, which every SQL engine can reproduce.
    """
    return hash_long(seed, *keys) / F.lit(float(1 << 48))


def hash_long(seed: int, *keys: Column | str) -> Column:
    """48-bit non-negative hash of the key columns; a null counts as a value of its own."""
    text = F.concat_ws(
        "|", F.lit(str(seed)), *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("\\N")) for k in keys]
    )
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` in which null keys meet null keys, keeping the left key columns."""
    if not keys:
        raise ValueError("null_safe_join needs at least one key")
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[F.col(c) for c in right.columns if c not in keys]
    )
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


# --------------------------------------------------------------------------- ranks without hot tasks


def bucketed_rank(
    df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str = "rank", limit: int | None = None
) -> DataFrame:
    """Exact 1-based rank within ``group`` by ``order``, computed per (group, bucket).

    ``bucket`` must grow with ``order``: every row of a lower bucket sorts before every row of a
    higher one. A window over the group alone would sort a hot group in a single task; here each
    task sorts one bucket and adds the number of rows in the buckets before it. The table of
    bucket sizes has groups x buckets rows. With ``limit`` only the first rows of each group are
    returned, and buckets that start beyond it are dropped before anything is sorted.
    """
    rows = df.withColumn("__bucket", bucket)
    sizes = rows.groupBy(*group, "__bucket").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*group, *([] if group else [F.lit(0)])).orderBy("__bucket")
    offsets = sizes.withColumn("__end", F.sum("__size").over(before)).select(
        *group, "__bucket", (F.col("__end") - F.col("__size")).alias("__offset")
    )
    if limit is not None:
        offsets = offsets.filter(F.col("__offset") < limit)
    placed = null_safe_join(rows, offsets, [*group, "__bucket"], "inner")
    inside = Window.partitionBy(*group, "__bucket").orderBy(*order)
    ranked = placed.withColumn(name, F.row_number().over(inside) + F.col("__offset"))
    if limit is not None:
        ranked = ranked.filter(F.col(name) <= limit)
    return ranked.drop("__bucket", "__offset")


def bucketed_sum(
    df: DataFrame, group: list[str], bucket: Column, order: list[Column], value: Column, name: str
) -> DataFrame:
    """Running total of ``value`` up to and including each row, split like :func:`bucketed_rank`."""
    rows = df.withColumn("__bucket", bucket).withColumn("__value", value)
    sizes = rows.groupBy(*group, "__bucket").agg(F.sum("__value").alias("__size"))
    before = Window.partitionBy(*group, *([] if group else [F.lit(0)])).orderBy("__bucket")
    offsets = sizes.withColumn(
        "__offset",
        F.coalesce(F.sum("__size").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).select(*group, "__bucket", "__offset")
    inside = (
        Window.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    summed = rows.withColumn("__run", F.sum("__value").over(inside))
    return (
        null_safe_join(summed, offsets, [*group, "__bucket"], "left")
        .withColumn(name, F.col("__run") + F.col("__offset"))
        .drop("__bucket", "__value", "__run", "__offset")
    )


def global_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """1-based position of every row in a total order, from one distributed range sort.

    The sort is written to shared storage before positions are read, so both uses below see the
    same partitions. The offset table has one row per sorted partition.
    """
    in_part = (1 << 33) - 1
    placed = cut_lineage(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftrightunsigned("__id", 33)).withColumn(
        "__row", F.col("__id").bitwiseAND(F.lit(in_part))
    )
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    run = Window.partitionBy(F.lit(0)).orderBy("__part")
    offsets = sizes.select(
        "__part", (F.sum("__size").over(run) - F.col("__size")).alias("__offset")
    )
    return (
        placed.join(offsets, "__part")
        .withColumn(name, F.col("__offset") + F.col("__row") + 1)
        .drop("__id", "__part", "__row", "__offset")
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """First ``k`` rows per key. Spark cuts each group to ``k`` before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def value_percentiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Exact linearly interpolated percentiles per group, from a table of value counts.

    Counting equal values first shrinks the shuffle to the number of distinct values, which is
    small for the counts, lengths and ratings this is used on. Use :func:`exact_quantiles` for
    continuous values.
    """
    freq = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__freq"))
    return freq.groupBy(*keys).agg(
        *[F.percentile(value, F.lit(p), F.col("__freq")).alias(n) for n, p in probs.items()]
    )


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of one continuous column as a single row.

    Equal values are counted first, so a value that fills a third of the rows is one row of the
    distributed sort. Running counts are formed per sorted partition and then offset.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    placed = cut_lineage(counts.orderBy(value).withColumn("__part", F.spark_partition_id()))
    sizes = placed.groupBy("__part").agg(F.sum("__n").alias("__size"))
    run = Window.partitionBy(F.lit(0)).orderBy("__part")
    offsets = sizes.select("__part", (F.sum("__size").over(run) - F.col("__size")).alias("__offset"))
    inside = Window.partitionBy("__part").orderBy(value)
    spans = placed.join(offsets, "__part").withColumn("__end", F.sum("__n").over(inside) + F.col("__offset"))
    total = placed.agg(F.sum("__n").cast("double")).scalar()

    def at(position: Column) -> Column:
        return F.max(F.when((position <= F.col("__end")) & (position > F.col("__end") - F.col("__n")), F.col(value)))

    parts = []
    for out, p in probs.items():
        exact = (total - 1) * F.lit(p)
        low, high = at(F.floor(exact) + 1), at(F.ceil(exact) + 1)
        parts.append((low + (high - low) * F.max(exact - F.floor(exact))).alias(out))
    return spans.agg(*parts)


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], parts: int = 1024) -> DataFrame:
    """Exact interpolated quantiles per group of a continuous column, for many groups at once.

    Ranks are narrowed down: each round counts the values of every range that still holds a wanted rank in ``parts``
    equal parts, and goes on with the part that holds it, until a range is a single value. What is kept is
    ``parts`` counts per group and rank, whatever the number of distinct values, so a hot group needs no sorted or
    gathered values; a range usually takes two to four rounds. Null and NaN values are left out; null keys
    are a group. Values must be finite.
    """
    found = df.select(*keys, F.col(value).cast("double").alias("__v"))
    found = stored(found.filter(F.col("__v").isNotNull() & ~F.isnan("__v")), "values")
    bounds = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    exact = {n: (F.col("__n") - 1) * F.lit(float(p)) for n, p in probs.items()}
    both = F.array_distinct(F.array(*[f(e).cast("bigint") for e in exact.values() for f in (F.floor, F.ceil)]))
    # rank: 0-based in the group; before: values of the group below the range
    targets = stored(bounds.select(*keys, "__n", F.explode(both).alias("__rank"), "__lo", "__hi", F.lit(0).cast("bigint").alias("__before")), "targets")
    done = [targets.filter("__lo = __hi").select(*keys, "__n", "__rank", F.col("__lo").alias("__x"))]
    left = targets.filter("__lo < __hi")
    while left.limit(1).count():
        ranges = left.select(*keys, "__lo", "__hi").distinct()
        inside = _join_groups(found, ranges, keys).filter("__v BETWEEN __lo AND __hi")
        half = lambda c: F.col(c) / 2  # noqa: E731  the width of a range may exceed the largest double
        part = F.least(F.floor((half("__v") - half("__lo")) / (half("__hi") - half("__lo")) * parts), F.lit(parts - 1)).alias("__part")
        counts = inside.groupBy(*keys, "__lo", "__hi", part).agg(F.count(F.lit(1)).alias("__k"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
        run = Window.partitionBy(*keys, "__lo", "__hi").orderBy("__part")
        counts = counts.withColumn("__end", F.sum("__k").over(run))
        hit = null_safe_join(left, counts, [*keys, "__lo", "__hi"], "inner")
        wanted = F.col("__rank") - F.col("__before")
        hit = hit.filter((wanted < F.col("__end")) & (wanted >= F.col("__end") - F.col("__k")))
        hit = hit.select(*keys, "__n", "__rank", F.col("__min").alias("__lo"), F.col("__max").alias("__hi"), (F.col("__before") + F.col("__end") - F.col("__k")).alias("__before"))
        targets = stored(hit, "targets")
        done.append(targets.filter("__lo = __hi").select(*keys, "__n", "__rank", F.col("__lo").alias("__x")))
        left = targets.filter("__lo < __hi")
    at = reduce(DataFrame.unionByName, done)

    def value_at(rank: Column) -> Column:
        return F.max(F.when(F.col("__rank") == rank.cast("bigint"), F.col("__x")))

    parts_of = [(value_at(F.floor(e)) + (value_at(F.ceil(e)) - value_at(F.floor(e))) * F.max(e - F.floor(e))).alias(n) for n, e in exact.items()]
    return at.groupBy(*keys).agg(*parts_of)


def _join_groups(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of the rows of equal groups; without keys all rows are one group."""
    if keys:
        return null_safe_join(left, right, keys, "inner")
    return left.withColumn("__one", F.lit(1)).join(right.withColumn("__one", F.lit(1)), "__one").drop("__one")


def explode_range(df: DataFrame, n: Column, name: str, chunk: int = 10_000) -> DataFrame:
    """One row per 1..n for each input row, spreading large ``n`` over tasks.

    The starts of the chunks are exploded and redistributed first, so no task holds or emits
    more than its share of a row that asks for billions.
    """
    step = F.lit(chunk).cast("bigint")
    starts = df.withColumn("__total", n.cast("bigint")).filter(F.col("__total") >= 1)
    starts = starts.withColumn("__start", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__total"), step)))
    starts = starts.repartition(F.col("__start"), F.col(df.columns[0]))
    last = F.least(F.col("__start") + chunk - 1, F.col("__total"))
    return starts.withColumn(name, F.explode(F.sequence(F.col("__start"), last))).drop("__total", "__start")
