"""Q: incremental jobs over the events."""

from pyspark.sql import functions as F

from prefmine.core import rnd, scratch_path
from prefmine.datasets import table
from prefmine.queries.registry import query
from prefmine.streaming import activity as A


def events(spark, d):
    stream = A.read_stream(spark, d, "events.parquet", table(spark, d, "events").schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("q01_user_stats_stream", """
SELECT user_id, count(*) AS review_count, count(DISTINCT event_type)::INT AS label_count, count(DISTINCT event_type) >= 3 AS is_bridge_user FROM events GROUP BY user_id
""", "")
def user_stats_stream(spark, d):
    path = scratch_path(spark, "q01")
    A.user_stats_stream(events(spark, d), "user_id", "event_type", f"{path}/out", f"{path}/state")
    return A.latest_user_stats(spark, f"{path}/out", "user_id", "event_type")


@query("q02_activity_windows", """
, w AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS rows, avg(value) AS mean_value FROM events GROUP BY 1)
SELECT day, rows, ROUND(mean_value, 6) AS mean_value FROM w WHERE (day + 1) * 86400 <= (SELECT floor(epoch(max(ts))) FROM events) - 3600
""".replace(", w AS", "WITH w AS", 1), "")
def activity_windows(spark, d):
    path = scratch_path(spark, "q02")
    A.activity_windows(events(spark, d), "ts", "value", f"{path}/out", f"{path}/state", "1 day", "1 hour")
    out = spark.read.parquet(f"{path}/out")
    return out.select(F.floor(F.unix_timestamp("start") / 86400).alias("day"), "rows", rnd("mean_value").alias("mean_value"))


@query("q03_dedup_stream", "SELECT DISTINCT user_id, event_type, json_extract_string(props, '$.k')::INT AS k FROM events", "")
def dedup_stream(spark, d):
    path = scratch_path(spark, "q03")
    rows = events(spark, d).select("ts", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    A.dedup_stream(rows, "ts", ["user_id", "event_type", "k"], f"{path}/out", f"{path}/state", "3650 days")
    return spark.read.parquet(f"{path}/out").select("user_id", "event_type", "k")
