"""Incremental versions of user statistics, activity windows and de-duplication.

Each job reads what is new, updates its state and stops (``availableNow``), so it can run on a
schedule or continuously with another trigger. State and output live in shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def _finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def user_stats_stream(events: DataFrame, user: str, label: str, path: str, checkpoint: str) -> None:
    """Rows per (user, label), kept as a table that every batch merges its own counts into.

    The stream has no state and no set of labels: a batch adds its counts to the table the batch before it left. Two
    folders take turns, so a batch that is run again starts from the same table, and only two copies are ever kept.
    """

    def merge(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(user, label).agg(F.count(F.lit(1)).alias("rows"))
        if number:
            before = batch.sparkSession.read.parquet(f"{path}/side={(number - 1) % 2}").select(user, label, "rows")
            counts = counts.unionByName(before).groupBy(user, label).agg(F.sum("rows").alias("rows"))
        counts.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/side={number % 2}")

    rows = events.select(user, label)
    _finish(rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start())


def latest_user_stats(spark: SparkSession, path: str, user: str, label: str, bridge_from: int = 3) -> DataFrame:
    """Rows and distinct labels per user, from the newest table the stream has written. Null labels are not counted as labels."""
    rows = spark.read.parquet(path)
    newest = rows.filter(F.col("batch") == rows.agg(F.max("batch")).scalar())
    stats = newest.groupBy(user).agg(F.sum("rows").alias("review_count"), F.count(label).cast("int").alias("label_count"))
    return stats.withColumn("is_bridge_user", F.col("label_count") >= bridge_from)


def activity_windows(events: DataFrame, ts: str, rating: str, path: str, checkpoint: str, width: str = "30 days", delay: str = "7 days") -> None:
    """Rows and mean value per tumbling window; a window is written once it can no longer change."""
    windows = events.withWatermark(ts, delay).groupBy(F.window(ts, width)).agg(F.count(F.lit(1)).alias("rows"), F.avg(rating).alias("mean_value"))
    flat = windows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "rows", "mean_value")
    _finish(flat.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def dedup_stream(events: DataFrame, ts: str, keys: list[str], path: str, checkpoint: str, delay: str) -> None:
    """First row per key; keys are remembered for ``delay``, which should cover how late copies arrive."""
    unique = events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    _finish(unique.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
