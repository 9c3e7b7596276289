"""How a site's staff directory is found in a corpus of pages: what is asked for in which order, and where it ends.

A site is asked for its front page; then for the paths where directories commonly are; then, from its front page again, for its best-scored
links. If none is an athletics directory, the athletics host that the front page links to is asked in the same way, once; then
the pages of single sports that a front page names, as many as the budget has left after what was asked before; at last a general directory that has
coaches among its people is taken. The first that is found ends the search.

What would be asked is known from the front pages alone, so a hop is a few joins: the plan of every site is laid out in order, met with the
pages there are, and cut at the first that ends it. Nothing is walked page by page, a site's plan is at most some fifty rows, and pages are
parsed only where they are front pages or pass the directory gate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import vocabulary as V
from rosterlake.functions import web as W
from rosterlake.operators import html as H
from rosterlake.operators.sites import candidates
from rosterlake.schemas import EntitySpec
from rosterlake.tables import materialise

#: Kinds of what is asked for, in their order within a hop.
FRONT, KNOWN, AGAIN, LINKED, SPORT = range(5)


def place_of(url: Column) -> Column:
    """Where a URL points, whatever its scheme, leading www, query or last slash."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-z]+://", "")
    host = W.bare_host(F.substring_index(bare, "/", 1))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/]*(/.*)?$", 1), "/+$", "")
    return F.concat(F.lower(host), path)


def judged_pages(pages: DataFrame, spec: EntitySpec, institutions: DataFrame | None = None) -> DataFrame:
    """pages(page_id, url, html, status) -> a row a place: page_id, whether it answered, refused or is barred by robots, whether it is an
    athletics directory, how many coaches a general one has, and whether it has staff by the lower gate of sport pages."""
    wide = candidates(pages.select("page_id", "url", "html"), spec, institutions)[1].select("page_id", "athletics", "coaches")
    sports = pages.where(place_of(F.col("url")).rlike(r"/sports/[^/]+/coaches/index$")).select("page_id", "url", "html")
    narrow = H.staff_rows(sports, spec, 2).groupBy("page_id").agg(F.count("*").alias("sport_staff"))
    code = W.status_class(F.col("status"))
    each = pages.select("page_id", place_of(F.col("url")).alias("place"), code.alias("answer")).join(wide, "page_id", "left").join(narrow, "page_id", "left")
    first = F.min(F.struct("page_id", "answer", "athletics", "coaches", "sport_staff")).alias("p")
    return each.groupBy("place").agg(first).select("place", "p.*")


def _fronts(hosts: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of hosts(host): their best links (host, place, n), their athletics host (host, to), the sports they name (host, slugs)."""
    front = pages.withColumn("place", place_of(F.col("url"))).join(hosts.select(F.col("host").alias("place")).distinct(), "place", "left_semi")
    front = front.where(W.status_class(F.col("status")) == "ok").groupBy("place").agg(F.min(F.struct("page_id", "url", "html")).alias("p"))
    front = materialise(front.select(F.col("place").alias("host"), "p.*"), "fronts")
    links = materialise(H.page_links(H.facts(front.select("page_id", "url", "html"), only=("links",))), "links")
    own = front.select("page_id", "host")
    order = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), F.asc("pos")))
    best = H.directory_links(links).withColumn("n", order).join(own, "page_id").select("host", place_of(F.col("url")).alias("place"), "n")
    to = H.athletics_host(links).join(own.withColumnRenamed("host", "at"), "page_id").select(F.col("at").alias("host"), W.bare_host(F.col("host")).alias("to"))
    return best, to, front.select("host", W.sport_slugs(F.col("html")).alias("slugs"))


def _hop(asked: DataFrame, hop: int, best: DataFrame, known: DataFrame) -> DataFrame:
    """asked(site, host): the plan of a hop without its sport pages, met with what is known of each place and cut where it ends."""
    path = lambda p: F.concat(F.col("host"), F.lit(p))
    fixed = [(FRONT, 0, F.col("host")), *[(KNOWN, i, path(p)) for i, p in enumerate(V.DIRECTORY_PATHS)], (AGAIN, 0, F.col("host"))]
    plan = asked.select("site", "host", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("n"), c.alias("place")) for k, i, c in fixed])).alias("x")).select("site", "host", "x.*")
    plan = plan.unionByName(asked.join(best, "host").select("site", "host", F.lit(LINKED).alias("kind"), "n", "place"))
    met = plan.join(known, "place", "left").withColumn("answer", F.coalesce("answer", F.lit("network")))
    dead = (F.col("kind") == FRONT) & (F.col("answer") != "ok")
    barred = (F.col("kind") == KNOWN) & (F.col("answer") == "robots")
    hit = F.col("kind").isin(KNOWN, LINKED) & (F.col("answer") == "ok") & F.coalesce("athletics", F.lit(False))
    met = met.withColumn("end", F.when(hit, "athletics").when(dead | barred, "refused")).withColumn("hop", F.lit(hop))
    order = Window.partitionBy("site").orderBy("kind", "n")
    return met.withColumn("over", F.max(F.col("end").isNotNull()).over(order.rowsBetween(Window.unboundedPreceding, -1))).where(~F.coalesce("over", F.lit(False))).drop("over")


def _sports(asked: DataFrame, hop: int, slugs: DataFrame, known: DataFrame, spent: DataFrame, budget: int) -> DataFrame:
    """The sport pages of asked(site, host), as far as the budget goes after `spent`(site, n)."""
    left = F.greatest(F.lit(0), F.lit(budget) - F.coalesce("n", F.lit(0)).cast("int"))
    named = asked.join(slugs, "host").join(spent, "site", "left").select("site", "host", F.posexplode(F.slice("slugs", 1, F.greatest(left, F.lit(1)))).alias("i", "slug"), left.alias("left"))
    plan = named.where(F.col("i") < F.col("left")).select("site", "host", F.lit(SPORT).alias("kind"), F.col("i").alias("n"), F.concat("host", F.lit("/sports/"), "slug", F.lit("/coaches/index")).alias("place"))
    met = plan.join(known, "place", "left").withColumn("answer", F.coalesce("answer", F.lit("network")))
    return met.withColumn("end", F.when((F.col("answer") == "ok") & (F.col("sport_staff") > 0), "sports")).withColumn("hop", F.lit(hop))


def discover(sites: DataFrame, pages: DataFrame, spec: EntitySpec, institutions: DataFrame | None = None, budget: int = 40) -> tuple[DataFrame, DataFrame]:
    """sites(domain), pages(page_id, url, html, status) -> (visits, outcomes). visits(site, step, hop, kind, place, page_id, answer) in
    the order of asking; outcomes(site, found, page_id, place, visits): athletics, sports, coaches or none. A site without a page is asked once."""
    known = materialise(judged_pages(pages, spec, institutions), "known")
    asked = materialise(sites.select(F.lower("domain").alias("site")).distinct().withColumn("host", W.bare_host(F.col("site"))), "asked")
    best, to, slugs = _fronts(asked, pages)
    first = materialise(_hop(asked, 0, best, known), "hop")
    ended = lambda v: v.where("end is not null").select("site").distinct()
    open_ = materialise(asked.join(ended(first), "site", "left_anti"), "open")
    there = materialise(open_.join(to, "host").select("site", F.col("to").alias("host")), "there")
    best1, _, slugs1 = _fronts(there, pages)
    second = materialise(_hop(there, 1, best1, known), "hop")
    general = lambda v: v.where(F.col("kind").isin(KNOWN, LINKED) & (F.col("answer") == "ok") & (~F.coalesce("athletics", F.lit(True))) & (F.col("coaches") > 0))
    spent = lambda v: v.groupBy("site").agg(F.count("*").alias("n"))
    # on the other host: its sport pages, then any general directory met so far
    both = first.unionByName(second)
    still = there.join(ended(second), "site", "left_anti")
    third = materialise(_sports(still, 1, slugs1, known, spent(both), budget), "sports")
    taken = ended(second.where("end = 'athletics'")).union(ended(third)).union(general(both).join(still.select("site"), "site", "left_semi").select("site")).distinct()
    fourth = materialise(_sports(open_.join(taken, "site", "left_anti"), 0, slugs, known, spent(both.unionByName(third)), budget), "sports")
    rank = F.when(F.col("hop") == 0, F.when(F.col("kind") == SPORT, 3).otherwise(0)).otherwise(F.when(F.col("kind") == SPORT, 2).otherwise(1))
    every = both.unionByName(third).unionByName(fourth).withColumn("part", rank)
    step = F.row_number().over(Window.partitionBy("site").orderBy("part", "kind", "n"))
    every = materialise(every.withColumn("step", step), "visits")
    found = every.where("end in ('athletics', 'sports')").groupBy("site").agg(F.min_by(F.struct("end", "page_id", "place"), "step").alias("f"))
    salvage = general(every).groupBy("site").agg(F.min_by(F.struct(F.lit("coaches").alias("end"), "page_id", "place"), "step").alias("g"))
    # a hop that was barred ends without a look at what it met before
    barred = first.where("end = 'refused'").select("site").distinct().withColumn("barred", F.lit(True))
    out = asked.join(spent(every).withColumnRenamed("n", "visits"), "site").join(found, "site", "left").join(salvage, "site", "left").join(barred, "site", "left")
    out = out.withColumn("x", F.coalesce("f", F.when(F.col("barred").isNull(), F.col("g"))))
    outcomes = out.select("site", F.coalesce("x.end", F.lit("none")).alias("found"), "x.page_id", "x.place", "visits")
    return every.select("site", "step", "hop", "kind", "place", "page_id", "answer"), outcomes
