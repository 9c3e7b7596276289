"""Queries: merge, lifecycle, outcomes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rosterlake.operators import merge as M
from rosterlake.operators import queries as Q
from rosterlake.operators import reconcile as R
from rosterlake.plans.adapters import adapter, cte
from rosterlake.plans.catalog import register
from rosterlake.schemas import EntitySpec

OBSERVED = EntitySpec("observation", "key", newest=("label",), join_unique=("sport",), union=("tags",), any_=("bought",), least=("first",), greatest=("last",))
JOINED = """, parts AS (SELECT key, seq, i, trim(p) AS p FROM (SELECT key, seq, unnest(string_split(sport, ';')) AS p, unnest(generate_series(1, len(string_split(sport, ';')))) AS i FROM observations) WHERE trim(p) <> ''),
  sports AS (SELECT key, string_agg(p, '; ' ORDER BY seq, i) AS sport FROM (SELECT key, p, arg_min(i, (seq, i)) AS i, min(seq) AS seq FROM parts GROUP BY key, p) GROUP BY key),
  tags AS (SELECT key, string_agg(tag, '; ' ORDER BY seq) AS tags FROM (SELECT key, tag, min(seq) AS seq FROM observations GROUP BY key, tag) GROUP BY key)"""


@register(
    "upsert_merge_observations",
    cte("observations") + JOINED + """ SELECT o.key, arg_max(label, seq) FILTER (WHERE label <> '') AS label, any_value(s.sport) AS sport, any_value(t.tags) AS tags, bool_or(bought) AS bought,
       min(day) AS first, max(day) AS last, count(*) AS n FROM observations o JOIN sports s ON o.key = s.key JOIN tags t ON o.key = t.key GROUP BY o.key""",
)
def upsert_merge_observations(spark, sf_dir):
    o = adapter(spark, sf_dir, "observations").select("key", "seq", "label", "sport", F.array("tag").alias("tags"), "bought", F.col("day").alias("first"), F.col("day").alias("last"))
    out = M.merge(o, OBSERVED)
    return out.select("key", "label", "sport", F.array_join("tags", "; ").alias("tags"), "bought", "first", "last", F.col("_n").alias("n"))


@register(
    "merge_map_overlay",
    cte("observations") + """, latest AS (SELECT key, tag, arg_max(day, seq) AS day, min(seq) AS s FROM observations GROUP BY key, tag)
       SELECT key, string_agg(tag || '=' || day, '; ' ORDER BY s) AS socials FROM latest GROUP BY key""",
)
def merge_map_overlay(spark, sf_dir):
    o = adapter(spark, sf_dir, "observations").select("key", "seq", F.create_map("tag", "day").alias("socials"))
    out = M.merge(o, EntitySpec("maps", "key", overlay=("socials",)))
    return out.select("key", Q.cell(F.col("socials"), "map<string,string>").alias("socials"))


@register(
    "merge_change_log",
    cte("observations") + """, cut AS (SELECT max(day) AS d FROM observations), old AS (SELECT key, bool_or(bought) AS gone FROM observations, cut WHERE day < d GROUP BY key), new AS (SELECT DISTINCT key FROM observations, cut WHERE day = d)
       SELECT coalesce(old.key, new.key) AS key, CASE WHEN old.key IS NULL THEN 'new' WHEN new.key IS NULL THEN 'kept' WHEN gone THEN 'returned' ELSE 'updated' END AS change FROM old FULL JOIN new ON old.key = new.key""",
)
def merge_change_log(spark, sf_dir):
    o = adapter(spark, sf_dir, "observations")
    o = o.join(F.broadcast(o.agg(F.max("day").alias("d"))))  # one row
    return M.change_log(o.where("day < d").withColumn("departed", F.col("bought")), o.where("day = d"))


@register("merge_counters", cte("observations") + """, cut AS (SELECT max(day) AS d FROM observations), old AS (SELECT DISTINCT key FROM observations, cut WHERE day < d), new AS (SELECT DISTINCT key FROM observations, cut WHERE day = d)
       SELECT count(*) FILTER (WHERE old.key IS NULL) AS new, count(*) FILTER (WHERE old.key IS NOT NULL AND new.key IS NOT NULL) AS updated, 0 AS returned, count(*) FILTER (WHERE new.key IS NULL) AS kept FROM old FULL JOIN new ON old.key = new.key""")
def merge_counters(spark, sf_dir):
    o = adapter(spark, sf_dir, "observations")
    o = o.join(F.broadcast(o.agg(F.max("day").alias("d"))))
    return M.run_counters(M.change_log(o.where("day < d"), o.where("day = d")))


RECONCILED = cte("people", "rosters") + """, met AS (SELECT DISTINCT domain FROM rosters),
  live AS (SELECT p.*, r.key IS NULL AND m.domain IS NOT NULL AND NOT departed AS missing FROM people p LEFT JOIN met m ON p.school_domain = m.domain LEFT JOIN rosters r ON p.school_domain = r.domain AND p.key = r.key),
  per AS (SELECT school_domain, count(*) FILTER (WHERE NOT departed) AS stored, count(*) FILTER (WHERE missing) AS missing FROM live JOIN met ON school_domain = domain GROUP BY 1),
  judged AS (SELECT *, stored >= 5 AND missing > 0.5 * stored AS skipped FROM per)"""


@register(
    "reconcile_departures",
    RECONCILED + """ SELECT l.key, l.departed OR (l.missing AND NOT coalesce(skipped, FALSE)) AS departed, CASE WHEN l.missing AND NOT coalesce(skipped, FALSE) THEN coalesce(departed_at, '2026-01-01T00:00:00Z') ELSE departed_at END AS departed_at
       FROM live l LEFT JOIN judged j ON l.school_domain = j.school_domain""",
)
def reconcile_departures(spark, sf_dir):
    out = R.reconcile(adapter(spark, sf_dir, "people"), adapter(spark, sf_dir, "rosters"), "2026-01-01T00:00:00Z")
    return out.select("key", "departed", "departed_at")


@register("reconcile_report", RECONCILED + " SELECT school_domain AS domain, stored, missing, CASE WHEN skipped THEN 0 ELSE missing END AS departed, skipped FROM judged WHERE missing > 0")
def reconcile_report(spark, sf_dir):
    return R.reconcile_report(adapter(spark, sf_dir, "people"), adapter(spark, sf_dir, "rosters"))


@register(
    "outcome_classification",
    cte("attempts") + """, per AS (SELECT domain, count(*) AS n, count(*) FILTER (WHERE status IN (401,403,405,406,429,451)) AS blocked, count(*) FILTER (WHERE status = 999) AS robots, count(*) FILTER (WHERE status = 0) AS net,
       count(*) FILTER (WHERE status BETWEEN 200 AND 299) AS ok, arg_min(url, seq) AS url, arg_min(url, seq) FILTER (WHERE status IN (401,403,405,406,429,451)) AS burl, arg_min(error, seq) FILTER (WHERE error <> '') AS err,
       list_sort(list(DISTINCT status) FILTER (WHERE status IN (401,403,405,406,429,451))) AS bcodes, list_sort(list(DISTINCT status) FILTER (WHERE status <> 0)) AS codes FROM attempts GROUP BY domain)
       SELECT domain, CASE WHEN blocked > 0 THEN 'blocked' WHEN robots > 0 THEN 'robots' WHEN net = n OR ok = 0 THEN 'network' ELSE 'no_directory' END AS status,
       CASE WHEN blocked > 0 THEN 'server refused automated requests (HTTP ' || array_to_string(bcodes, ', ') || ')' WHEN robots > 0 THEN 'robots.txt disallows the pages we need' WHEN net = n THEN coalesce(err, 'no response')
            WHEN ok = 0 THEN 'no page fetched successfully (HTTP ' || array_to_string(codes, ', ') || ')' ELSE 'site reachable but no staff directory found in ' || n || ' request(s)' END AS detail,
       CASE WHEN blocked > 0 THEN burl ELSE url END AS url FROM per""",
)
def outcome_classification(spark, sf_dir):
    a = adapter(spark, sf_dir, "attempts")
    return R.classify_outcomes(a.select("domain"), a)


@register("outcome_tally", cte("site_outcomes") + """ SELECT status, count(*) AS n, CASE status WHEN 'ok' THEN 'scraped' WHEN 'blocked' THEN 'blocked the bot (HTTP 403/429)' WHEN 'network' THEN 'network failure / timeout' WHEN 'no_directory' THEN 'no staff directory found' ELSE 'unhandled error' END AS label FROM site_outcomes GROUP BY status""")
def outcome_tally(spark, sf_dir):
    return R.outcome_tally(adapter(spark, sf_dir, "site_outcomes"))


@register("latest_run_sites", cte("site_outcomes") + " SELECT run_id, pos, domain, status FROM site_outcomes WHERE run_id = (SELECT max(run_id) FROM site_outcomes)")
def latest_run_sites(spark, sf_dir):
    return R.latest_run(adapter(spark, sf_dir, "site_outcomes")).select("run_id", "pos", "domain", "status")


FAILING = cte("site_outcomes") + """, bad AS (SELECT domain, arg_max(status, (run_id, pos)) AS status FROM site_outcomes WHERE status IN ('blocked', 'network', 'error') GROUP BY domain),
  good AS (SELECT DISTINCT domain FROM site_outcomes WHERE status = 'ok')"""


@register("still_failing_hosts", FAILING + " SELECT domain, status FROM bad WHERE domain NOT IN (SELECT domain FROM good)")
def still_failing_hosts(spark, sf_dir):
    return R.still_failing(adapter(spark, sf_dir, "site_outcomes"))


@register("recovered_hosts", FAILING + " SELECT count(*) AS recovered FROM bad WHERE domain IN (SELECT domain FROM good)")
def recovered_hosts(spark, sf_dir):
    return R.recovered(adapter(spark, sf_dir, "site_outcomes"))


@register("retry_allow_list", cte("site_outcomes") + """ SELECT r.domain, r.pos, r.domain IN (SELECT domain FROM site_outcomes WHERE status IN ('blocked', 'network', 'error') AND people = 0) AS accepted
       FROM (SELECT domain, min(pos) AS pos FROM site_outcomes GROUP BY domain) r""")
def retry_allow_list(spark, sf_dir):
    s = adapter(spark, sf_dir, "site_outcomes")
    return R.retry_list(s.select("domain", "pos"), s.where("people = 0"))


@register("run_summary", cte("site_outcomes") + """, r AS (SELECT status, domain, detail, row_number() OVER (PARTITION BY status ORDER BY pos) AS r FROM site_outcomes WHERE status <> 'ok')
       SELECT status, CASE status WHEN 'blocked' THEN 'blocked the bot (HTTP 403/429)' WHEN 'network' THEN 'network failure / timeout' WHEN 'no_directory' THEN 'no staff directory found' ELSE 'unhandled error' END AS label, count(*) AS n,
       string_agg(domain, ', ' ORDER BY r) FILTER (WHERE r <= 3) AS examples, string_agg(domain || ': ' || substr(detail, 1, 70), chr(10) ORDER BY r) FILTER (WHERE r <= 3) AS lines, greatest(0, count(*) - 3) AS more FROM r GROUP BY status""")
def run_summary(spark, sf_dir):
    return R.run_summary(adapter(spark, sf_dir, "site_outcomes"))


@register("run_counts", cte("site_outcomes") + """ SELECT count(*) AS attempted, count(*) FILTER (WHERE status = 'ok') AS succeeded, count(*) FILTER (WHERE status <> 'ok') AS failed, count(*) FILTER (WHERE status IN ('blocked', 'network', 'error')) AS retryable,
       CAST(round_even(100.0 * count(*) FILTER (WHERE status = 'ok') / count(*), 0) AS INT) || '%' AS share FROM site_outcomes""")
def run_counts(spark, sf_dir):
    return R.run_counts(adapter(spark, sf_dir, "site_outcomes"))


@register("skipped_domains", RECONCILED + " SELECT school_domain AS domain, missing, stored FROM judged WHERE skipped ORDER BY missing DESC, school_domain LIMIT 10")
def skipped_domains(spark, sf_dir):
    return R.skipped_domains(R.reconcile_report(adapter(spark, sf_dir, "people"), adapter(spark, sf_dir, "rosters")))


@register("fetch_stats", cte("attempts") + """ SELECT count(*) AS requests, count(*) FILTER (WHERE status BETWEEN 200 AND 299) AS ok, count(*) FILTER (WHERE status IN (401,403,405,406,429,451)) AS blocked,
       count(*) FILTER (WHERE status = 999) AS robots, count(*) FILTER (WHERE status = 0) AS errors, count(*) FILTER (WHERE status = 429) AS throttled, count(*) FILTER (WHERE seq % 8 = 0) AS rendered, count(*) FILTER (WHERE seq % 10 = 0) AS cache_hits FROM attempts""")
def fetch_stats(spark, sf_dir):
    return R.fetch_stats(adapter(spark, sf_dir, "attempts").withColumn("rendered", F.col("seq") % 8 == 0).withColumn("cached", F.col("seq") % 10 == 0))


@register("host_gaps", cte("attempts") + """, g AS (SELECT domain AS host, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY domain ORDER BY ts, seq) AS gap FROM attempts)
       SELECT host, count(gap) AS gaps, round(min(gap), 3) AS least, round(avg(gap), 2) AS mean FROM g WHERE gap IS NOT NULL GROUP BY host""")
def host_gaps(spark, sf_dir):
    return R.host_gaps(adapter(spark, sf_dir, "attempts").withColumnRenamed("domain", "host")).select("host", "gaps", F.round("least", 3).alias("least"), F.round("mean", 2).alias("mean"))


def _waits(attempts):
    return attempts.withColumn("retry_after", F.when(F.col("seq") % 3 == 0, F.col("seq") % 50))


BACKOFF = cte("attempts") + """, a AS (SELECT domain, seq, ts, status IN (401,403,405,406,429,451,503) AS push, CASE WHEN status IN (401,403,405,406,429,451,503) THEN 1.0 WHEN status BETWEEN 200 AND 299 THEN -1.0 ELSE 0.0 END AS step, CASE WHEN seq % 3 = 0 THEN seq % 50 END AS w FROM attempts)
  SELECT domain, round(list_reduce(list_prepend(1.0::DOUBLE, list(step::DOUBLE ORDER BY seq)), lambda p, d: CASE WHEN d > 0 THEN least(p * 2, 16) WHEN d < 0 THEN greatest(1, p / sqrt(2)) ELSE p END), 6) AS penalty,
         round(arg_max(epoch(ts) + w, seq) FILTER (WHERE push AND w > 0), 3) AS cooldown_until, count(*) AS responses FROM a GROUP BY domain"""


def _backoff(rows):
    return rows.select(F.col("host").alias("domain"), F.round("penalty", 6).alias("penalty"), F.round("cooldown_until", 3).alias("cooldown_until"), "responses")


@register("host_backoff_state", BACKOFF)
def host_backoff_state(spark, sf_dir):
    return _backoff(R.backoff_state(_waits(adapter(spark, sf_dir, "attempts")), host="domain"))


@register("stream_backoff_state", BACKOFF)
def stream_backoff_state(spark, sf_dir):
    """The same of a stream: the last that was said of each host."""
    from rosterlake.plans.adapters import SQL
    from rosterlake.streaming import penalty_stream
    from rosterlake.tables import shared_dir, table

    path = f"{shared_dir(spark)}/backoff-{uuid.uuid4().hex}"
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")
    log = _waits(spark.sql(SQL["attempts"], events=events))
    put = lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")
    out = penalty_stream(log, host="domain")
    out.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    said = spark.read.schema(out.schema).parquet(path)
    return _backoff(said.groupBy("host").agg(F.max_by(F.struct("penalty", "cooldown_until", "responses"), "responses").alias("r")).select("host", "r.*"))


@register(
    "stream_reconcile",
    cte("people", "rosters") + """, met AS (SELECT DISTINCT domain FROM rosters), came AS (SELECT p.key FROM people p JOIN rosters r ON p.school_domain = r.domain AND p.key = r.key),
  live AS (SELECT p.key, p.school_domain, p.departed AND c.key IS NULL AS gone, c.key IS NULL AND m.domain IS NOT NULL AND NOT p.departed AS missing FROM people p LEFT JOIN came c ON p.key = c.key LEFT JOIN met m ON p.school_domain = m.domain),
  per AS (SELECT school_domain, count(*) FILTER (WHERE NOT gone) AS stored, count(*) FILTER (WHERE missing) AS missing FROM live GROUP BY 1)
  SELECT l.key, l.gone OR (l.missing AND NOT (stored >= 5 AND p.missing > 0.5 * stored)) AS departed FROM live l JOIN per p ON l.school_domain = p.school_domain""",
)
def stream_reconcile(spark, sf_dir):
    """People as a store; those on a roster come as a stream, and its batch marks who is missing."""
    from rosterlake.schemas import PERSON, person
    from rosterlake.store import Store
    from rosterlake.streaming import upsert_stream
    from rosterlake.tables import shared_dir

    path = f"{shared_dir(spark)}/reconcile-{uuid.uuid4().hex}"
    p = with_lists(adapter(spark, sf_dir, "people")).withColumn("source", F.lit("table"))
    full = p.select("key", *[(F.col(f.name) if f.name in p.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in PERSON])
    store = Store(spark, f"{path}/store", person())
    store.commit(full)
    came = full.join(adapter(spark, sf_dir, "rosters").select(F.col("domain").alias("school_domain"), "key"), ["school_domain", "key"], "left_semi").withColumn("seq", F.lit(1))
    came.write.parquet(f"{path}/in")
    # one run is one batch, whatever files it came in
    rows = spark.readStream.schema(came.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{path}/in")
    rosters = lambda df: df.select(F.col("school_domain").alias("domain"), "key")
    upsert_stream(rows, store, f"{path}/state", rosters=rosters, now="2026-01-01T00:00:00Z").awaitTermination()
    return store.read().select("key", F.coalesce("departed", F.lit(False)).alias("departed"))


@register("shared_address_flag", cte("people") + """, each AS (SELECT school_domain, key, unnest(list_filter([email, email2], lambda x: x IS NOT NULL)) AS e FROM people), wide AS (SELECT school_domain, e, count(DISTINCT key) AS n FROM each GROUP BY ALL),
       flag AS (SELECT key, min(n) AS least FROM each JOIN wide USING (school_domain, e) GROUP BY key) SELECT p.key, coalesce(least >= 3, FALSE) AS shared_email FROM people p LEFT JOIN flag f ON p.key = f.key""")
def shared_address_flag(spark, sf_dir):
    p = with_lists(adapter(spark, sf_dir, "people"))
    return M.shared_emails(p).select("key", "shared_email")


def with_lists(p):
    return p.withColumn("emails", F.array_compact(F.array("email", "email2"))).withColumn("phones", F.array_compact(F.array("phone")))


@register("cache_ttl", cte("attempts") + """, m AS (SELECT max(epoch(ts)) AS now FROM attempts) SELECT domain AS url, arg_max(seq, ts) AS seq FROM attempts, m WHERE status IN (200,201,203,204,301,308,404,410) AND now - epoch(ts) <= 604800 GROUP BY domain""")
def cache_ttl(spark, sf_dir):
    from rosterlake.sources.files import live_cache

    a = adapter(spark, sf_dir, "attempts").select(F.col("domain").alias("url"), "seq", "status", F.col("ts").cast("timestamp").cast("double").alias("fetched_at"))
    now = a.agg(F.max("fetched_at").alias("now")).first()["now"] or 0.0
    return live_cache(a, now).select("url", "seq")


@register("cache_purge", cte("attempts") + """, m AS (SELECT max(epoch(ts)) AS now FROM attempts) SELECT count(*) FILTER (WHERE now - epoch(ts) > 604800) AS expired, count(*) FILTER (WHERE now - epoch(ts) <= 604800) AS live FROM attempts, m""")
def cache_purge(spark, sf_dir):
    from rosterlake.sources.files import purge_counts

    a = adapter(spark, sf_dir, "attempts").select(F.col("ts").cast("timestamp").cast("double").alias("fetched_at"))
    return purge_counts(a, a.agg(F.max("fetched_at").alias("now")).first()["now"] or 0.0)


@register("forward_fill_sections", """ WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM documents),
       h AS (SELECT doc_id, pos, CASE WHEN length(line) < 40 THEN line END AS section FROM lines) SELECT doc_id, pos, last_value(section IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h""")
def forward_fill_sections(spark, sf_dir):
    from rosterlake.tables import table

    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    h = lines.select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), F.when(F.length("line") < 40, F.col("line")).alias("section"))
    return M.forward_fill(h, "section", "doc_id", "pos")
