"""Structured Streaming: upserts by micro-batch, windows, sessions, de-duplication with a time limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.store import Store


def event_stream(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def upsert_stream(rows: DataFrame, store: Store, checkpoint: str, seconds: int | None = None, rosters=None, now: str | None = None):
    """Each micro-batch folds onto the store; it is a run. rosters, a function of the batch, gives the whole memberships it
    holds (domain, key), and who is missing from them is marked as departed at `now` with the same commit. A batch rewrites the
    buckets its keys fall into, and its number is committed with them, so one met twice after a failure is left out.
    seconds sets the trigger; None takes what there is and stops."""

    def fold(df: DataFrame, number: int) -> None:
        store.upsert(df, rosters=rosters(df) if rosters else None, now=now, batch=(checkpoint, number))

    write = rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (write.trigger(processingTime=f"{seconds} seconds") if seconds else write.trigger(availableNow=True)).start()


def penalty_stream(log: DataFrame, factor: float = 2.0, cap: float = 16.0, host: str = "host", seq: str = "seq") -> DataFrame:
    """backoff_state over a stream: each host's multiplier, hold-off and count as of each batch that has heard of it (output
    mode update). The state of a host is these three numbers; within a batch its responses go in order of `seq`."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    from rosterlake.operators.reconcile import PENALTY, after, push_backs

    def step(key, frames, state):
        penalty, until, n = state.get if state.exists else (1.0, None, 0)
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        penalty = after(penalty, rows["step"], factor, cap)
        asked = rows[rows["wait"] > 0]
        if len(asked):
            until = float(asked["ts"].iloc[-1] + asked["wait"].iloc[-1])
        n += len(rows)
        state.update((penalty, until, n))
        yield pd.DataFrame({"host": [key[0]], "penalty": [penalty], "cooldown_until": pd.Series([until], dtype="float64"), "responses": [n]})

    kept = "penalty double, cooldown_until double, responses long"
    return push_backs(log, host, seq).groupBy("host").applyInPandasWithState(step, PENALTY, kept, "update", GroupStateTimeout.NoTimeout)


def idle_penalty_stream(log: DataFrame, idle: float, late: str = "1 hour", factor: float = 2.0, cap: float = 16.0, host: str = "host", seq: str = "seq") -> DataFrame:
    """penalty_stream that forgets: a host that hasn't answered for `idle` seconds of the log's own time (its column ts) loses its state,
    and starts anew when it is heard of again. What is kept is the hosts of the last `idle` seconds, however many there have been. A host that is
    forgotten is said once more, with multiplier 1 and no responses. Needs a state store with timers (RocksDB)."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    from rosterlake.operators.reconcile import PENALTY, after, push_backs

    class Penalties(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.state = handle.getValueState("penalty", "penalty double, until double, n long, timer long")

        def handleInputRows(self, key, rows, timerValues):
            penalty, until, n, timer = self.state.get() if self.state.exists() else (1.0, None, 0, None)
            end = timer
            pdf = pd.concat(list(rows)).sort_values("at", kind="stable")
            for ts, step, wait in zip(pdf["ts"].tolist(), pdf["step"].tolist(), pdf["wait"].tolist()):
                if end is not None and ts * 1000 > end:  # back after all that time, whether or not its timer has gone off
                    penalty, until, n = 1.0, None, 0
                penalty, n = after(penalty, (step,), factor, cap), n + 1
                until = ts + wait if wait and wait > 0 else until
                end = max(end or 0, int((ts + idle) * 1000))
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(end)
            self.state.update((penalty, until, n, end))
            yield pd.DataFrame({"host": [key[0]], "penalty": [penalty], "cooldown_until": pd.Series([until], dtype="float64"), "responses": [n]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.state.clear()
            yield pd.DataFrame({"host": [key[0]], "penalty": [1.0], "cooldown_until": pd.Series([None], dtype="float64"), "responses": [0]})

        def close(self):
            pass

    rows = push_backs(log.withWatermark("ts", late), host, seq)
    return rows.groupBy("host").transformWithStateInPandas(Penalties(), PENALTY, "Update", "EventTime")


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s, "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def fresh_only(fetches: DataFrame, ttl: str = "7 days") -> DataFrame:
    """The first response of each URL within the time to live."""
    return fetches.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["url"])
