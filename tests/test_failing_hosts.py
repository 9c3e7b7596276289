"""Failing and recovered hosts are judged over the whole run history."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlake.plans import lifecycle


def test_failing_hosts_read_all_runs(spark, tmp_path):
    rows = [(1, 1, "signup", "2024-01-02"), (2, 1, "view", "2024-01-28"), (3, 2, "click", "2024-01-03"), (4, 2, "error", "2024-01-04"), (5, 3, "view", "2023-05-01"), (6, 3, "signup", "2023-06-01"), (7, 4, "purchase", "2024-01-29")]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string").select("*", F.lit(0.0).alias("value"))
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in lifecycle.still_failing_hosts(spark, str(tmp_path)).collect()] == [("host2.example", "error")]
    assert lifecycle.recovered_hosts(spark, str(tmp_path)).first()["recovered"] == 2
