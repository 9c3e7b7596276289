"""Repairs of stored people: each takes and returns person rows, so dry runs are a diff of before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import people as P
from rosterlake.functions import web as W
from rosterlake.functions.text import union_lists
from rosterlake.operators import lookups as L
from rosterlake.operators.merge import rekey


def titles(rows: DataFrame) -> DataFrame:
    """Addresses in titles move to emails; the rest of the noise goes."""
    return rows.withColumn("emails", union_lists(F.col("emails"), W.emails_in(F.col("title")))).withColumn("title", P.clean_title(F.col("title")))


def phones(rows: DataFrame) -> DataFrame:
    return rows.withColumn("phones", F.array_distinct(F.transform("phones", W.format_phone)))


def names(rows: DataFrame, spec) -> DataFrame:
    """Decorations go, keys follow, rows that now share a key fold."""
    return rekey(rows.withColumn("name", P.strip_decorations(F.col("name"))), spec)


def departments(rows: DataFrame) -> DataFrame:
    return L.colleague_departments(rows)


def sports(rows: DataFrame) -> DataFrame:
    """Coaches without a sport get their title's; departments of schools where each is one person's go."""
    rows = rows.withColumn("sport", F.when((F.coalesce("sport", F.lit("")) == "") & F.col("is_coach"), P.sport_from_title(F.col("title"))).otherwise(F.col("sport")))
    bad = L.departments_all_unique(rows).select("school_domain").withColumn("_bad", F.lit(True))
    return rows.join(bad, "school_domain", "left").withColumn("department", F.when(F.col("_bad").isNull(), F.col("department"))).drop("_bad")


def school_names(rows: DataFrame, institutions: DataFrame) -> DataFrame:
    return L.official_names(rows, institutions).drop("school_changed")


def drop_phantoms(rows: DataFrame) -> DataFrame:
    return rows.join(L.phantoms(rows).where("covered").select("key"), "key", "left_anti")


def drop_placeholders(rows: DataFrame) -> DataFrame:
    return rows.where(~P.is_placeholder_name(F.col("name")))


def source_urls(rows: DataFrame, workbook: DataFrame, runs: DataFrame) -> DataFrame:
    found = L.source_urls(rows, workbook, runs).withColumnRenamed("source_url", "_url")
    return rows.join(found, "key", "left").withColumn("source_url", F.coalesce(F.when(F.coalesce("source_url", F.lit("")) != "", F.col("source_url")), "_url")).drop("_url")


def workbook_people(rows: DataFrame, blocked: DataFrame, sport: str = "Men's Basketball") -> DataFrame:
    """Positional workbook rows (pos, removed, school, state, first, last, position, email, phone) as people of blocked
    schools; removed and nameless rows are skipped."""
    name = F.concat_ws(" ", "first", "last")
    ok = rows.where((F.lower(F.coalesce("removed", F.lit(""))) != "y") & (F.trim(name) != ""))
    hit = L.workbook_matches(ok, blocked).where("host is not null")
    mail, phone = F.lower(F.trim("email")), W.clean_phone(F.col("phone"))
    empty = F.array().cast("array<string>")
    return hit.select(
        "pos", P.normalize_person_name(name).alias("name"), F.col("host").alias("school_domain"), "school", P.clean_title(F.col("position")).alias("title"), F.lit(sport).alias("sport"),
        F.when(W.email_ok(mail), F.array(mail)).otherwise(empty).alias("emails"), F.when(phone.isNotNull(), F.array(phone)).otherwise(empty).alias("phones"), P.is_coaching_title(F.col("position")).alias("is_coach"),
    )


def changed(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows a repair changes, drops and adds."""
    h = lambda df, name: df.select("key", F.xxhash64(*columns).alias(name))
    j = h(before, "a").join(h(after, "b"), "key", "full_outer")
    n = lambda cond, name: F.count_if(cond).alias(name)
    return j.agg(n(F.col("a") != F.col("b"), "changed"), n(F.col("b").isNull(), "dropped"), n(F.col("a").isNull(), "added"))


def affected_domains(before: DataFrame, after: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """The domains with most rows changed or dropped by a repair; equal ones by name."""
    a = before.select("key", "school_domain", F.xxhash64(*columns).alias("a"))
    j = a.join(after.select("key", F.xxhash64(*columns).alias("b")), "key", "left").where(~F.col("a").eqNullSafe(F.col("b")))
    return j.groupBy("school_domain").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "school_domain").limit(top)
