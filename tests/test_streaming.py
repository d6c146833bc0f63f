"""Incremental jobs over several runs."""

from pyspark.sql import functions as F

from prefmine.streaming import activity as A

SCHEMA = "user bigint, label string"


def _stats(df):
    return {
        tuple(r)
        for r in df.groupBy("user").agg(F.count(F.lit(1)).alias("review_count"), F.countDistinct("label").cast("int").alias("label_count"))
        .withColumn("is_bridge_user", F.col("label_count") >= 3).collect()
    }


def test_user_stats_over_three_runs(spark, tmp_path):
    """A hot user, null users and labels, labels seen again in later runs; two tables are kept, whatever the number of runs."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batches = [
        [(1, f"l{i % 7}") for i in range(500)] + [(2, "a"), (2, None), (None, "a")],
        [(1, "l3"), (2, "b"), (3, None), (None, None)],
        [(2, "c"), (2, "a"), (4, "z")],
    ]
    seen = []
    for rows in batches:
        seen += rows
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        A.user_stats_stream(A.read_stream(spark, source, "*.parquet", SCHEMA), "user", "label", out, state)
        got = A.latest_user_stats(spark, out, "user", "label")
        assert {tuple(r) for r in got.collect()} == _stats(spark.createDataFrame(seen, SCHEMA))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["side=0", "side=1"]
