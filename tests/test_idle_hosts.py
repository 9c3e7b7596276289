"""A host that stays away loses its back-off state."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from rosterlake.streaming import event_stream, idle_penalty_stream, penalty_stream


def test_idle_host_is_forgotten(spark, tmp_path):
    at = lambda s: datetime(2026, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)
    batches = [[("a.edu", 1, 429, 0), ("a.edu", 2, 429, 10), ("b.edu", 3, 429, 0)], [("b.edu", 4, 200, 1000)], [("b.edu", 5, 200, 2000)], [("a.edu", 6, 429, 2100), ("b.edu", 7, 429, 2110)], [("b.edu", 8, 200, 2120)]]
    kind = "host string, seq long, status int, ts timestamp"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(h, n, s, at(t)) for h, n, s, t in rows], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        import time

        time.sleep(0.05)  # files are taken in the order of their times
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen: dict[str, list] = {"idle": [], "kept": []}
    last = {}
    try:
        src = spark.read.schema(kind).parquet(f"{tmp_path}/in").schema
        for name, make in (("idle", lambda s: idle_penalty_stream(s, idle=300, late="0 seconds")), ("kept", penalty_stream)):
            put = lambda df, n, name=name: seen[name].extend((n, r["host"], round(r["penalty"], 3), r["responses"]) for r in df.collect())
            q = make(event_stream(spark, f"{tmp_path}/in", src)).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
            q.awaitTermination()
            last[name] = q.recentProgress
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    of = lambda name, host: [x[2:] for x in seen[name] if x[1] == host]
    assert of("kept", "a.edu") == [(4.0, 2), (8.0, 3)]
    assert of("idle", "a.edu")[:3] == [(4.0, 2), (1.0, 0), (2.0, 1)]
    assert of("idle", "b.edu") == [(2.0, 1), (1.0, 1), (1.0, 1), (2.0, 2), (1.414, 3)]  # gaps of 1000 seconds, then of 110
