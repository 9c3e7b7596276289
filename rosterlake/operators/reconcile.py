"""Departures: stored people absent from a complete roster, guarded against mass loss; and reports on outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import vocabulary as V
from rosterlake.functions.web import status_class


def _judged(stored: DataFrame, rosters: DataFrame, max_loss: float, floor: int) -> DataFrame:
    """Live stored rows with _missing and their domain's verdict."""
    seen = rosters.select(F.lower("domain").alias("domain"), "key").where("key is not null").distinct().withColumn("_seen", F.lit(True))
    domains = seen.select("domain").distinct().withColumn("_met", F.lit(True))
    live = stored.withColumn("domain", F.lower("school_domain"))
    live = live.join(domains, "domain", "left").join(seen, ["domain", "key"], "left")
    live = live.withColumn("_missing", ~F.coalesce("departed", F.lit(False)) & F.coalesce("_met", F.lit(False)) & F.col("_seen").isNull())
    per = live.where(~F.coalesce("departed", F.lit(False)) & F.col("_met")).groupBy("domain").agg(F.count("*").alias("stored"), F.count_if("_missing").alias("missing"))
    per = per.withColumn("skip", (F.col("stored") >= floor) & (F.col("missing") / F.col("stored") > max_loss))
    return live.join(per, "domain", "left")


def reconcile(stored: DataFrame, rosters: DataFrame, now: str, max_loss: float = 0.5, floor: int = 5) -> DataFrame:
    """stored(key, school_domain, departed, departed_at, ...) with departures marked. rosters(domain, key) hold whole
    memberships; a domain without rows says nothing. A domain that would lose more than max_loss of at least floor live
    people is left alone. The first departure date stays."""
    j = _judged(stored, rosters, max_loss, floor)
    go = F.col("_missing") & ~F.coalesce("skip", F.lit(False))
    out = j.withColumn("departed", F.coalesce("departed", F.lit(False)) | go).withColumn("departed_at", F.when(go, F.coalesce("departed_at", F.lit(now))).otherwise(F.col("departed_at")))
    return out.select(*stored.columns)


def missing(stored: DataFrame, rosters: DataFrame) -> DataFrame:
    """Live stored rows of domains that have a roster, without those it lists."""
    return _judged(stored, rosters, 1.0, 0).where("_missing").select(*stored.columns)


def reconcile_report(stored: DataFrame, rosters: DataFrame, max_loss: float = 0.5, floor: int = 5) -> DataFrame:
    """domain, stored, missing, departed, skipped: domains that lose anyone, or would."""
    j = _judged(stored, rosters, max_loss, floor).where("missing > 0").groupBy("domain").agg(F.first("stored").alias("stored"), F.first("missing").alias("missing"), F.first("skip").alias("skipped"))
    return j.select("domain", "stored", "missing", F.when(F.col("skipped"), 0).otherwise(F.col("missing")).cast("long").alias("departed"), "skipped")


def classify_outcomes(sites: DataFrame, attempts: DataFrame) -> DataFrame:
    """sites(domain) ⟕ attempts(domain, seq, url, status, body, error) -> domain, status, detail, url of sites without
    people: the most actionable reason first."""
    a = attempts.withColumn("_c", status_class(F.col("status"), F.col("body")))
    of = lambda c: F.count_if(F.col("_c") == c)
    codes = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_set(F.when(cond, F.col("status")))), lambda x: x.cast("string")), ", ")
    per = a.groupBy("domain").agg(
        F.count("*").alias("n"), of("blocked").alias("blocked"), of("robots").alias("robots"), of("network").alias("network"), of("ok").alias("ok"),
        codes(F.col("_c") == "blocked").alias("blocked_codes"), codes(F.col("status") != 0).alias("codes"),
        F.min_by("url", "seq").alias("first_url"), F.min_by("url", F.when(F.col("_c") == "blocked", F.col("seq"))).alias("blocked_url"),
        F.min_by("error", F.when(F.coalesce("error", F.lit("")) != "", F.col("seq"))).alias("first_error"),
    )
    j = sites.select("domain").distinct().join(per, "domain", "left")
    none = F.col("n").isNull()
    status = F.when(none, "network").when(F.col("blocked") > 0, "blocked").when(F.col("robots") > 0, "robots").when((F.col("network") == F.col("n")) | (F.col("ok") == 0), "network").otherwise("no_directory")
    unread = F.lit("no page fetched successfully")
    detail = (
        F.when(none, "no requests completed")
        .when(F.col("blocked") > 0, F.concat(F.lit("server refused automated requests (HTTP "), "blocked_codes", F.lit(")")))
        .when(F.col("robots") > 0, "robots.txt disallows the pages we need")
        .when(F.col("network") == F.col("n"), F.coalesce("first_error", F.lit("no response")))
        .when(F.col("ok") == 0, F.when(F.col("codes") != "", F.concat(unread, F.lit(" (HTTP "), "codes", F.lit(")"))).otherwise(unread))
        .otherwise(F.concat(F.lit("site reachable but no staff directory found in "), F.col("n").cast("string"), F.lit(" request(s)")))
    )
    return j.select("domain", status.alias("status"), detail.alias("detail"), F.when(F.col("blocked") > 0, F.col("blocked_url")).otherwise(F.col("first_url")).alias("url"))


def still_failing(sites: DataFrame, statuses: tuple[str, ...] = V.RETRYABLE) -> DataFrame:
    """sites(run_id, pos, domain, status): domains whose failures no later or earlier success answers, with their last."""
    bad = sites.where(F.col("status").isin(*statuses)).groupBy("domain").agg(F.max_by("status", F.struct("run_id", "pos")).alias("status"))
    return bad.join(sites.where("status = 'ok'").select("domain").distinct(), "domain", "left_anti")


def recovered(sites: DataFrame, statuses: tuple[str, ...] = V.RETRYABLE) -> DataFrame:
    bad = sites.where(F.col("status").isin(*statuses)).select("domain").distinct()
    return bad.join(sites.where("status = 'ok'").select("domain").distinct(), "domain", "left_semi").agg(F.count("*").alias("recovered"))


def retry_list(requested: DataFrame, sites: DataFrame) -> DataFrame:
    """requested(pos, domain) -> each domain once, in order, accepted if it ever failed in a retryable way."""
    allowed = sites.where(F.col("status").isin(*V.RETRYABLE)).select("domain").distinct().withColumn("_ok", F.lit(True))
    ask = requested.groupBy("domain").agg(F.min("pos").alias("pos"))
    return ask.join(allowed, "domain", "left").select("domain", "pos", F.coalesce("_ok", F.lit(False)).alias("accepted"))


def outcome_tally(sites: DataFrame) -> DataFrame:
    from rosterlake.functions.text import lookup

    return sites.groupBy("status").agg(F.count("*").alias("n")).select("status", "n", lookup(F.col("status"), V.OUTCOME_LABELS, F.col("status")).alias("label"))


def run_summary(sites: DataFrame, examples: int = 3) -> DataFrame:
    """Failures by status, most first: label, count, the first examples with their details and how many more. The
    rank filter lets each task keep its own first rows, so a status with most of the rows isn't gathered."""
    from pyspark.sql import Window

    from rosterlake.functions.text import lookup

    failed = sites.where("status <> 'ok'")
    count = failed.groupBy("status").agg(F.count("*").alias("n"))
    ranked = failed.withColumn("r", F.row_number().over(Window.partitionBy("status").orderBy("pos"))).where(F.col("r") <= examples)
    shown = F.struct("r", "domain", F.concat_ws(": ", "domain", F.substring("detail", 1, 70)).alias("line"))
    few = ranked.groupBy("status").agg(F.array_sort(F.collect_list(shown)).alias("x"))
    j = count.join(few, "status").withColumn("label", lookup(F.col("status"), V.OUTCOME_LABELS, F.col("status")))
    names = lambda c: F.transform("x", lambda e: e[c])
    return j.select("status", "label", "n", F.array_join(names("domain"), ", ").alias("examples"), F.array_join(names("line"), "\n").alias("lines"), F.greatest(F.lit(0).cast("long"), F.col("n") - examples).alias("more")).orderBy(F.desc("n"), "status")


def run_counts(sites: DataFrame) -> DataFrame:
    """Sites attempted, succeeded, failed and worth retrying, with the share that succeeded."""
    from rosterlake.functions.text import percent

    ok, n = F.count_if(F.col("status") == "ok"), F.count("*")
    return sites.agg(n.alias("attempted"), ok.alias("succeeded"), F.count_if(F.col("status") != "ok").alias("failed"), F.count_if(F.col("status").isin(*V.RETRYABLE)).alias("retryable"), percent(ok, n).alias("share"))


def skipped_domains(report: DataFrame, top: int = 10) -> DataFrame:
    """Of a reconcile_report the domains that would have lost too many, most missing first; equal ones by name."""
    return report.where("skipped").orderBy(F.desc("missing"), "domain").select("domain", "missing", "stored").limit(top)


def latest_run(sites: DataFrame) -> DataFrame:
    last = sites.agg(F.max("run_id").alias("run_id"))
    return sites.join(F.broadcast(last), "run_id")  # one row


def fetch_stats(log: DataFrame) -> DataFrame:
    """log(status[, rendered, cached]) as counters; flags that a log lacks count 0."""
    c = status_class(F.col("status"))
    n = lambda cond, name: F.count_if(cond).alias(name)
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in log.columns else F.lit(False)
    return log.agg(
        F.count("*").alias("requests"), n(c == "ok", "ok"), n(c == "blocked", "blocked"), n(c == "robots", "robots"), n(c == "network", "errors"), n(F.col("status") == 429, "throttled"),
        n(flag("rendered"), "rendered"), n(flag("cached"), "cache_hits"),
    )


def host_gaps(log: DataFrame, ts: str = "ts", host: str = "host") -> DataFrame:
    """Seconds between requests to one host: how many, least and mean."""
    from pyspark.sql import Window

    w = Window.partitionBy(host).orderBy(ts, "seq")
    gap = F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(w)
    return log.select(host, gap.alias("gap")).where("gap is not null").groupBy(host).agg(F.count("*").alias("gaps"), F.min("gap").alias("least"), F.avg("gap").alias("mean"))


PENALTY = "host string, penalty double, cooldown_until double, responses long"


def push_backs(log: DataFrame, host: str, order: str) -> DataFrame:
    """log -> host, at (order), ts, step (1 a push-back, -1 a success, else 0) and wait (seconds a push-back asks for)."""
    push = F.col("status").isin(429, 503, *V.BLOCKED_STATUSES)
    step = F.when(push, 1).when(F.col("status").between(200, 299), -1).otherwise(0)
    wait = F.when(push & (F.col("retry_after") > 0), F.col("retry_after").cast("double")) if "retry_after" in log.columns else F.lit(None).cast("double")
    ts = F.col("ts").cast("timestamp").cast("double") if "ts" in log.columns else F.lit(None).cast("double")
    return log.select(F.col(host).alias("host"), F.col(order).cast("long").alias("at"), ts.alias("ts"), step.alias("step"), wait.alias("wait"))


def after(penalty: float, steps, factor: float, cap: float) -> float:
    for s in steps:
        if s > 0:
            penalty = min(penalty * factor, cap)
        elif s < 0:
            penalty = max(1.0, penalty / factor**0.5)
    return penalty


def backoff_state(log: DataFrame, factor: float = 2.0, cap: float = 16.0, host: str = "host", seq: str = "seq") -> DataFrame:
    """Delay multiplier of each host after its responses in order: times factor up to cap on push-back, divided by its
    square root (at least 1) on success; and until when the last push-back that named a wait asks to hold off. Hosts are
    sorted, not gathered: a task carries one host's state from batch to batch, however long its log is."""
    import pyarrow as pa

    def run(batches):
        last, penalty, until, n = None, 1.0, None, 0

        def row():
            return pa.RecordBatch.from_pydict({"host": [last], "penalty": [penalty], "cooldown_until": pa.array([until], pa.float64()), "responses": [n]})

        for batch in batches:
            for h, ts, step, wait in zip(*(batch.column(c).to_pylist() for c in ("host", "ts", "step", "wait"))):
                if h != last and n:
                    yield row()
                    penalty, until, n = 1.0, None, 0
                last, n = h, n + 1
                penalty = after(penalty, (step,), factor, cap)
                until = ts + wait if wait and ts is not None else until
        if n:
            yield row()

    return push_backs(log, host, seq).repartition("host").sortWithinPartitions("host", "at").mapInArrow(run, PENALTY)
