"""Lookup and matching joins."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import schools as S
from rosterlake.functions import vocabulary as V
from rosterlake.functions.text import null_blank, packed
from rosterlake.functions.web import normalize_domain
from rosterlake.tables import materialise


def host_values(institutions: DataFrame, value: str) -> DataFrame:
    """host -> value over institutions in key order, the athletics host before the website's; first wins, rows without
    the value are skipped."""
    hosts = F.array(F.struct(F.lit(0).alias("rank"), F.col("athletics_domain").alias("host")), F.struct(F.lit(1).alias("rank"), normalize_domain(F.col("website")).alias("host")))
    each = institutions.where((F.coalesce(F.col(value), F.lit("")) != "")).select("key", F.col(value).alias("_v"), F.explode(hosts).alias("h")).where("h.host is not null and h.host <> ''")
    return each.groupBy(F.col("h.host").alias("host")).agg(F.min_by("_v", F.struct("key", "h.rank")).alias(value))


def with_division(people: DataFrame, institutions: DataFrame) -> DataFrame:
    d = host_values(institutions, "division").withColumnRenamed("host", "school_domain")
    return people.drop("division").join(d, "school_domain", "left")


def official_names(people: DataFrame, institutions: DataFrame) -> DataFrame:
    """school from the institutions where the host is known, else the cleaned title; school_changed says whether it is new."""
    names = host_values(institutions, "school").select(F.col("host").alias("school_domain"), F.col("school").alias("_official"))
    j = people.join(names, "school_domain", "left")
    new = F.coalesce(null_blank(F.col("_official")), S.clean_school_name(F.col("school")))
    return j.withColumn("school_changed", ~F.col("school").eqNullSafe(new)).withColumn("school", new).drop("_official")


def host_map(institutions: DataFrame) -> DataFrame:
    """University host -> athletics host, the last by key winning."""
    rows = institutions.select(normalize_domain(F.col("website")).alias("host"), "athletics_domain", "key").where("host is not null and athletics_domain is not null and athletics_domain <> host")
    return rows.groupBy("host").agg(F.max_by("athletics_domain", "key").alias("athletics_domain"))


def import_match(rows: DataFrame, institutions: DataFrame) -> DataFrame:
    """rows(pos, school, state, link) against stored institutions by name and state, an unknown state matching an unknown
    one: pos, key (null if unmatched), host, verdict (unmatched, no_link, already_known, conflicting, filled) and
    replaced (filled over the university's own host)."""
    left = rows.select("pos", "school", S.normalize_name(F.col("school")).alias("n"), S.state_code(F.col("state")).alias("s"), normalize_domain(F.col("link")).alias("host"))
    right = institutions.select("key", S.normalize_name(F.col("school")).alias("n2"), S.state_code(F.col("state")).alias("s2"), "athletics_domain", normalize_domain(F.col("website")).alias("site"))
    j = left.join(right, (F.col("n") == F.col("n2")) & F.col("s").eqNullSafe(F.col("s2")), "left")
    own = F.coalesce("athletics_domain", F.lit(""))
    verdict = (
        F.when(F.col("key").isNull(), "unmatched").when(F.col("host").isNull(), "no_link").when(own == F.col("host"), "already_known")
        .when((own != "") & (own != F.coalesce("site", F.lit(""))), "conflicting").otherwise("filled")
    )
    return j.select("pos", "school", "key", "host", verdict.alias("verdict"), ((verdict == "filled") & (own != "")).alias("replaced"))


def import_report(matched: DataFrame) -> DataFrame:
    n = lambda what: F.count_if(F.col("verdict") == what).alias(what)
    return matched.agg(F.count_distinct("pos").alias("rows"), n("filled"), n("already_known"), n("conflicting"), n("unmatched"), n("no_link"), F.count_if("replaced").alias("replaced"))


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of target a and candidate b."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        m, out, last = difflib.SequenceMatcher(None), [], None
        for p, q in zip(x, y):
            if p is None or q is None:
                out.append(None)
                continue
            m.set_seqs(p, q)
            out.append(m.ratio())
        return pd.Series(out, dtype="float64")

    return ratio(a, b)


#: What a fuzzy key is written with.
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letter_counts(key: Column) -> Column:
    return F.array(*[F.length(key) - F.length(F.replace(key, F.lit(x), F.lit(""))) for x in _LETTERS])


def most_similar(a: Column, b: Column, counts_a: Column, counts_b: Column) -> Column:
    """What the ratio of two keys can be at most: their common letters, in any order, over half their lengths."""
    common = F.aggregate(F.zip_with(counts_a, counts_b, lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * common / both)


def fuzzy_top1(targets: DataFrame, candidates: DataFrame, least: float = 0.6) -> DataFrame:
    """targets(pos, name, state) and candidates(cid, name, state): the most similar candidate of the same state whose
    name shares the first distinctive word; ties to the smaller cid; nothing under `least`.

    Equal names are compared once. A pair is compared only if its letters allow `least` and, after the pair that they
    allow most has been compared for each target, that pair's ratio: the rest can't win, so nothing is lost."""
    block = lambda c: F.lower(F.get(F.split(S.search_term(c), r"\s+"), 0))
    place = lambda c: F.struct(block(c).alias("b"), F.col("state").alias("s"))
    t = targets.select("pos", F.col("name").alias("target"), place(F.col("name")).alias("at"), S.fuzzy_key(F.col("name")).alias("tk"))
    c = candidates.select("cid", F.col("name").alias("candidate"), place(F.col("name")).alias("at"), S.fuzzy_key(F.col("name")).alias("ck"))
    named = lambda df: df.where("at.b is not null")
    goals = named(t).select("at", "tk").distinct().withColumn("tn", letter_counts(F.col("tk")))
    offers = named(c).groupBy("at", "ck").agg(F.min(F.struct("cid", "candidate")).alias("c")).withColumn("cn", letter_counts(F.col("ck"))).withColumnRenamed("at", "at2")
    same = (F.col("at.b") == F.col("at2.b")) & F.col("at.s").eqNullSafe(F.col("at2.s"))
    top = most_similar(F.col("tk"), F.col("ck"), F.col("tn"), F.col("cn"))
    pairs = materialise(goals.join(offers, same).select("at", "tk", "ck", "c", top.alias("top")).where(F.col("top") >= least), "pairs")
    first = pairs.groupBy("at", "tk").agg(F.max_by("ck", "top").alias("ck"))
    first = materialise(first.select("at", "tk", similarity(F.col("tk"), F.col("ck")).alias("reached")), "first")
    both = pairs.join(first.select(F.col("at").alias("at2"), F.col("tk").alias("tk2"), "reached"), same & (F.col("tk") == F.col("tk2")))
    open_ = both.where(F.col("top") >= F.col("reached")).select("at", "tk", "ck", "c")
    scored = open_.withColumn("score", similarity(F.col("tk"), F.col("ck"))).where(F.col("score") >= least)
    best = scored.groupBy("at", "tk").agg(F.max_by(F.struct("c", "score"), F.struct("score", -F.col("c.cid"))).alias("m"))
    best = best.select(F.col("at").alias("at2"), F.col("tk").alias("tk2"), "m.c.cid", "m.c.candidate", "m.score")
    return named(t).join(best, same & (F.col("tk") == F.col("tk2"))).select("pos", "target", "cid", "candidate", "score")


def enrich(members: DataFrame, matches: DataFrame) -> DataFrame:
    """members(pos, city, state, region, website, association, private) with what their match says: city, website and state
    where it has them, region, cost, test scores and ownership as they are there. matches(pos, city, state, website, cost,
    scores map, ownership). notes say what is missing."""
    said = matches.select("pos", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in ("city", "state", "website", "cost", "scores", "ownership")])
    j = members.join(said, "pos", "left")
    pick = lambda c, new: F.coalesce(null_blank(new), F.col(c))
    hit = F.coalesce("_hit", F.lit(False))
    scores = F.when(hit & (F.size("_scores") > 0), F.col("_scores"))
    note = F.when(~hit, V.NO_MATCH_NOTE).when(scores.isNull(), F.when(F.col("association") == "NJCAA", V.OPEN_ADMISSION_NOTE).otherwise(V.TEST_OPTIONAL_NOTE))
    return j.select(
        "pos", pick("city", F.trim("_city")).alias("city"), pick("state", S.state_name(F.col("_state"))).alias("state"), F.when(hit, S.region_for(F.col("_state"))).otherwise(F.col("region")).alias("region"),
        pick("website", F.trim("_website")).alias("website"), "association", F.col("_cost").alias("totalYearlyCost"), scores.alias("academicData"),
        F.when(hit, S.private_public(F.col("_ownership"), F.col("private"))).alias("privatePublic"), F.array_compact(F.array(note)).alias("notes"),
    )


def update_records(matched: DataFrame, institutions: DataFrame) -> DataFrame:
    """Filled rows of import_match as records that fold onto the stored ones: their identity, and the new athletics host; the
    first row of a school counts."""
    first = matched.where("verdict = 'filled'").groupBy("key").agg(F.min(F.struct("pos", "host")).alias("m"))
    own = [c for c in ("ncaa_org_id", "school", "state", "country", "association") if c in institutions.columns]
    return institutions.select("key", *own).join(first, "key").select("key", *own, F.col("m.host").alias("athletics_domain"))


def import_listings(matched: DataFrame, institutions: DataFrame, conflicts: int = 10, unmatched: int = 5) -> DataFrame:
    """The first conflicting rows, with the host kept and the one offered, and the first unmatched ones."""
    kept = institutions.select("key", F.col("athletics_domain").alias("current"))
    a = matched.where("verdict = 'conflicting'").join(kept, "key").select(F.lit("conflicting").alias("verdict"), "pos", "school", "current", F.col("host").alias("offered")).orderBy("pos", "school").limit(conflicts)
    none = F.lit(None).cast("string")
    return a.union(matched.where("verdict = 'unmatched'").select(F.lit("unmatched"), "pos", "school", none, none).orderBy("pos").limit(unmatched))


def source_urls(people: DataFrame, workbook: DataFrame, runs: DataFrame) -> DataFrame:
    """people(key, school, sport, school_domain): the page each came from. workbook(school, url), if a school has one URL
    there; runs(run_id, domain, url, people): the latest with people. Basketball men take the workbook's first."""
    books = workbook.where("url is not null").groupBy(S.normalize_name(F.col("school")).alias("_n")).agg(F.collect_set("url").alias("u")).select("_n", F.when(F.size("u") == 1, F.get("u", 0)).alias("book"))
    last = runs.where("people > 0 and url is not null").groupBy(F.col("domain").alias("school_domain")).agg(F.max_by("url", "run_id").alias("run_url"))
    j = people.withColumn("_n", S.normalize_name(F.col("school"))).join(books, "_n", "left").join(last, "school_domain", "left")
    own = F.when(F.lower("sport") == "men's basketball", F.col("book"))
    return j.select("key", F.coalesce(own, F.col("run_url"), F.col("book")).alias("source_url"))


def colleague_departments(people: DataFrame, page: str = "school_domain") -> DataFrame:
    """Departments without parts that are the name of someone at the same school."""
    part = people.select("key", page, F.posexplode(packed(F.col("department"))).alias("p", "t"))
    names = people.select(page, F.lower("name").alias("_n")).distinct()
    kept = part.join(names, (part[page] == names[page]) & (F.lower("t") == F.col("_n")), "left_anti")
    new = kept.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "t"))), lambda x: x["t"]), "; ").alias("_d"))
    return people.join(new, "key", "left").withColumn("department", F.col("_d")).drop("_d")


def departments_all_unique(people: DataFrame, page: str = "school_domain", at_least: int = 3) -> DataFrame:
    """Schools with at_least departments, each of one person: they are names, not departments."""
    n = people.where("department is not null and department <> ''").groupBy(page, "department").agg(F.count("*").alias("n"))
    return n.groupBy(page).agg(F.count("*").alias("departments"), F.max("n").alias("most")).where((F.col("departments") >= at_least) & (F.col("most") == 1)).select(page, "departments")


def phantoms(people: DataFrame, page: str = "school_domain") -> DataFrame:
    """Rows without a letter in their name: deletable if all their addresses are held by named people of the school."""
    from rosterlake.functions.people import is_phantom

    ghost = people.where(is_phantom(F.col("name"))).select("key", page, "emails")
    known = people.where(~is_phantom(F.col("name"))).select(page, F.explode("emails").alias("email")).distinct().withColumn("_k", F.lit(1))
    each = ghost.select("key", page, F.explode_outer("emails").alias("email")).join(known, [page, "email"], "left")
    return each.groupBy("key").agg((F.min(F.when(F.col("email").isNotNull() & F.col("_k").isNotNull(), 1).otherwise(0)) == 1).alias("covered"))


def placeholders(people: DataFrame, page: str = "school_domain") -> DataFrame:
    """Rows whose name is a vacancy marker, with the addresses nobody else at the school has."""
    from rosterlake.functions.people import is_placeholder_name

    gone = people.where(is_placeholder_name(F.col("name")))
    other = people.where(~is_placeholder_name(F.col("name"))).select(page, F.explode("emails").alias("email")).distinct()
    sole = gone.select("key", page, F.explode("emails").alias("email")).join(other, [page, "email"], "left_anti").groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("email")), "; ").alias("sole_addresses"))
    return gone.select("key", "name").join(sole, "key", "left")


def workbook_matches(rows: DataFrame, blocked: DataFrame) -> DataFrame:
    """rows(pos, school, state) with the host of the blocked school of the same name and state; null host: a miss."""
    b = blocked.groupBy(S.normalize_name(F.col("school")).alias("n"), F.lower("state").alias("s")).agg(F.min_by("host", "pos").alias("host"))
    r = rows.withColumn("n", S.normalize_name(F.col("school"))).withColumn("s", F.lower("state"))
    return r.join(b, ["n", "s"], "left").drop("n", "s")


def top_k(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
