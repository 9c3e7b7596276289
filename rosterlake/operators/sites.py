"""From the pages of sites to their people: a page is judged as a candidate, a site chooses among its candidates, and each site
ends with one outcome. Compositions of the page, lookup and outcome operators; pages are parsed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import schools as S
from rosterlake.functions import vocabulary as V
from rosterlake.functions import web as W
from rosterlake.operators import html as H
from rosterlake.operators.lookups import host_map, host_values
from rosterlake.operators.merge import merge, shared_emails
from rosterlake.operators.reconcile import classify_outcomes
from rosterlake.schemas import EntitySpec
from rosterlake.tables import materialise


def page_schools(pages: DataFrame, institutions: DataFrame | None) -> DataFrame:
    """pages(page_id, url, html) -> page_id, domain, school: the institution's name where the host is known, else the title's."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    out = pages.select("page_id", W.normalize_domain(F.col("url")).alias("domain"), S.school_title(title).alias("_title"))
    if institutions is None:
        return out.select("page_id", "domain", F.col("_title").alias("school"))
    known = host_values(institutions, "school").select(F.col("host").alias("domain"), F.col("school").alias("_known"))
    return out.join(known, "domain", "left").select("page_id", "domain", F.coalesce("_known", "_title").alias("school"))


def candidates(pages: DataFrame, spec: EntitySpec, institutions: DataFrame | None = None, signals: int = 5) -> tuple[DataFrame, DataFrame]:
    """(people, pages): the staff rows of pages that pass the gate, with the page's school, and of each page with people its
    domain, school, whether it is an athletics directory, and how many people it has. A page without people is no candidate."""
    people = materialise(H.staff_rows(pages, spec, signals), "staff")
    share = H.athletics_share(people).select("page_id", "athletics")
    count = people.groupBy("page_id").agg(F.count("*").alias("people"), F.count_if(F.size("emails") > 0).alias("with_email"), F.count_if("is_coach").alias("coaches"))
    judged = page_schools(pages, institutions).join(count, "page_id").join(share, "page_id").join(pages.select("page_id", "url"), "page_id")
    judged = materialise(judged, "candidates")
    own = [c for c in people.columns if c != "school"]
    return people.select(*own).join(judged.select("page_id", "school"), "page_id"), judged


def sport_candidate(pages: DataFrame, spec: EntitySpec, institutions: DataFrame | None = None, most: int = 40) -> tuple[DataFrame, DataFrame]:
    """Pages of single sports (page_id in the order of visit, url, html) as one candidate a domain: the first `most` of a domain,
    by the lower gate, their people folded across the pages. The candidate's page is the first with people."""
    from rosterlake.operators.lookups import top_k

    some = top_k(pages.withColumn("_d", W.normalize_domain(F.col("url"))), "_d", [F.asc("page_id")], most).select("page_id", "url", "html")
    people, judged = candidates(some, spec, institutions, 2)
    first = judged.groupBy("domain").agg(F.min_by(F.struct("page_id", "url"), "page_id").alias("p"), F.min_by("school", F.when(F.col("school").isNotNull(), F.col("page_id"))).alias("school"))
    # page order first, then the order on the page, which staff_rows has folded into one row a key
    folded = merge(people.withColumn("_k", F.struct("school_domain", "key")).drop("key").withColumnRenamed("_k", "key").withColumn("seq", F.col("page_id")), spec)
    folded = folded.drop("_n", "page_id").withColumn("key", F.col("key.key"))
    rows = materialise(folded.drop("school").join(first.select(F.col("domain").alias("school_domain"), F.col("p.page_id").alias("page_id"), "school"), "school_domain"), "sports")
    share = H.athletics_share(rows).select("page_id", "athletics")
    count = rows.groupBy("page_id").agg(F.count("*").alias("people"), F.count_if(F.size("emails") > 0).alias("with_email"), F.count_if("is_coach").alias("coaches"))
    return rows, first.select("domain", "school", "p.page_id", "p.url").join(count, "page_id").join(share, "page_id").select(*judged.columns)


def site_people(sites: DataFrame, pages: DataFrame, attempts: DataFrame, spec: EntitySpec, institutions: DataFrame, signals: int = 5) -> tuple[DataFrame, DataFrame]:
    """sites(domain) -> (people, outcomes). A university's host stands for its athletics host. Of a site's candidate pages, in
    page order, the first athletics directory counts, else the coaches of the first other page that has any; a site that refused
    (blocked or robots) and has none falls back to the college's own host. Outcomes are domain, status, detail, people, url,
    school: ok, empty (a directory page without people), else the reason that the attempts(domain, seq, url, status, body, error) show."""
    hosts = host_map(institutions)
    to = sites.select("domain").distinct().join(hosts.withColumnRenamed("host", "domain"), "domain", "left").select(F.col("domain").alias("seed"), F.coalesce("athletics_domain", "domain").alias("host"))
    failed = classify_outcomes(to.select(F.col("host").alias("domain")), attempts).select(F.col("domain").alias("host"), "status", "detail", "url")
    back = hosts.groupBy(F.col("athletics_domain").alias("host")).agg(F.min("host").alias("college"))
    to = materialise(to.join(failed, "host", "left").join(back, "host", "left"), "sites")
    people, judged = candidates(pages, spec, institutions, signals)
    ranked = judged.where("athletics or coaches > 0").groupBy(F.col("domain").alias("host")).agg(F.min(F.struct((~F.col("athletics")).alias("general"), "page_id", "url", "school")).alias("c"))
    mine = to.join(ranked, "host", "left")
    college = ranked.select(F.col("host").alias("college"), F.col("c").alias("c2"))
    refused = F.col("status").isin("blocked", "robots")
    mine = mine.join(college, "college", "left").withColumn("c", F.coalesce("c", F.when(refused, F.col("c2")))).drop("c2")
    mine = materialise(mine, "chosen")
    chosen = mine.where("c is not null").select("seed", "c.page_id", "c.general", "c.url", "c.school")
    rows = people.drop("school").join(chosen.select("seed", "page_id", "general", "school"), "page_id").where("is_coach or not general")
    kept = H.from_titles(rows.where("general")).unionByName(rows.where("not general").withColumn("notes", F.array().cast("array<string>")))
    kept = materialise(shared_emails(kept.drop("general"), page="seed"), "people")
    count = kept.groupBy("seed").agg(F.count("*").alias("people"), F.count_if(F.size("emails") > 0).alias("with_email"))
    gated = pages.where(W.looks_like_directory(F.col("html"), signals)).groupBy(W.normalize_domain(F.col("url")).alias("host")).agg(F.min_by("url", "page_id").alias("gate_url"))
    out = mine.select("seed", "host", "status", "detail", "url", F.col("c").alias("x")).join(count, "seed", "left").join(gated, "host", "left")
    kind = F.when(F.col("x.general"), V.GENERAL_KIND).otherwise(V.ATHLETICS_KIND)
    done, empty = F.col("people") > 0, F.col("gate_url").isNotNull()
    outcomes = out.select(
        F.col("seed").alias("domain"), F.when(done, "ok").when(empty, "empty").otherwise(F.col("status")).alias("status"),
        F.when(done, F.concat(F.col("with_email").cast("string"), F.lit(V.OK_DETAIL), kind, F.lit(")"))).when(empty, V.EMPTY_DETAIL).otherwise(F.col("detail")).alias("detail"),
        F.coalesce("people", F.lit(0).cast("long")).alias("people"), F.when(done, F.col("x.url")).when(empty, F.col("gate_url")).otherwise(F.col("url")).alias("url"), F.col("x.school").alias("school"),
    )
    return kept, outcomes
