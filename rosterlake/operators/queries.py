"""The read side: filters, search, sorting, paging, facets, statistics, cells and exports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import people as P
from rosterlake.functions import schools as S
from rosterlake.functions.text import cell, is_blank, percent, sort_value
from rosterlake.functions.web import normalize_domain

has = lambda c: F.coalesce(F.size(F.col(c)) > 0, F.lit(False))
filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
_false = lambda c: F.coalesce(F.col(c), F.lit(False))


def record_search(rows: DataFrame, needle: str) -> Column:
    """Rows with the needle in any value, whatever case. Values only: field names don't match."""
    kinds = dict(rows.dtypes)
    return reduce(lambda a, b: a | b, [F.contains(F.lower(cell(F.col(c), kinds[c])), F.lit(needle.lower())) for c in rows.columns])


def filter_companies(rows: DataFrame, has_email=False, has_phone=False, industry: str | None = None, hiring=False, search: str | None = None) -> DataFrame:
    if has_email:
        rows = rows.where(has("emails"))
    if has_phone:
        rows = rows.where(has("phones"))
    if industry:
        rows = rows.where(F.exists("industry_hints", lambda h: F.contains(F.lower(h), F.lit(industry.lower()))))
    if hiring:
        rows = rows.where(_false("has_open_roles"))
    return rows.where(record_search(rows, search)) if search else rows


def filter_people(rows: DataFrame, has_email=False, has_phone=False, sport: str | None = None, coaches_only=False, direct_email=False, search: str | None = None, include_departed=False, departed_only=False, divisions: str | None = None) -> DataFrame:
    if departed_only:
        rows = rows.where(_false("departed"))
    elif not include_departed:
        rows = rows.where(~_false("departed"))
    if has_email:
        rows = rows.where(has("emails"))
    if has_phone:
        rows = rows.where(has("phones"))
    if coaches_only:
        rows = rows.where(_false("is_coach"))
    if direct_email:
        rows = rows.where(has("emails") & ~_false("shared_email"))
    if divisions:
        rows = rows.where(division_in(F.col("division"), divisions))
    if sport:
        labels = F.col("sport_labels") if "sport_labels" in rows.columns else P.sport_labels(F.col("sport"))
        rows = rows.where(P.sport_match(F.col("sport"), labels, F.col("department"), sport))
    return rows.where(record_search(rows, search)) if search else rows


def division_in(c: Column, wanted: str) -> Column:
    """c is one of the comma-separated divisions; a packed value counts with each of its parts."""
    from rosterlake.functions.text import packed

    asked = F.array(*[S.normalize_division(F.lit(w)) for w in wanted.split(",") if w.strip()])
    return F.arrays_overlap(packed(c), asked)


def state_in(c: Column, wanted: list[str], unknown_too: bool = False) -> Column:
    asked = F.array(*[S.state_code(F.lit(w)) for w in wanted])
    hit = F.coalesce(F.array_contains(F.array_compact(asked), S.state_code(c)), F.lit(False))
    return hit | S.state_code(c).isNull() if unknown_too else hit


def name_contains(c: Column, needles: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(n.lower()) for n in needles]), lambda n: F.contains(F.lower(c), n))


def page(rows: DataFrame, sort: str, key: str = "key", descending=False, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page sorted by any column, blanks last either way, ties by key; a top-k, not a full sort, for small pages."""
    if sort not in rows.columns:
        raise ValueError(f"no column {sort}")
    if not (offset >= 0 and 1 <= limit <= 10_000):
        raise ValueError("offset from 0, limit from 1 to 10000")
    kind = dict(rows.dtypes)[sort]
    v = sort_value(F.col(sort), kind)
    out = rows.orderBy(is_blank(F.col(sort), kind).cast("int"), v.desc_nulls_last() if descending else v.asc_nulls_last(), key)
    return out.offset(offset).limit(limit)


def _page_order(rows: DataFrame, sort: str, key: str, descending: bool) -> tuple[DataFrame, list[Column]]:
    """rows with the columns their order goes by, _blank, _value and the key, and that order."""
    if sort not in rows.columns:
        raise ValueError(f"no column {sort}")
    kind = dict(rows.dtypes)[sort]
    rows = rows.withColumn("_blank", is_blank(F.col(sort), kind).cast("int")).withColumn("_value", sort_value(F.col(sort), kind))
    return rows, [F.col("_blank").asc(), F.col("_value").desc_nulls_last() if descending else F.col("_value").asc_nulls_last(), F.col(key).asc()]


def page_after(rows: DataFrame, sort: str, after: tuple | None = None, key: str = "key", descending=False, limit: int = 50) -> tuple[DataFrame, Callable[[], tuple | None]]:
    """(page, cursor): the rows that come after a cursor in the order of `page`, and a function that gives the page's own cursor, None if it
    is empty. A cursor is the place of a page's last row, so a page far into the order reads past nothing: the rows before it are filtered
    out, pushed into the scan where the sorted column is stored as it is, and the top-k holds `limit` rows at any depth."""
    ordered, by = _page_order(rows, sort, key, descending)
    if after is not None:
        blank, value, last = after
        v, further = F.col("_value"), F.col(key) > F.lit(last)
        if value is None:  # the last of its kind
            rest = v.isNull() & further
        else:
            beyond = v < F.lit(value) if descending else v > F.lit(value)
            rest = v.isNull() | beyond | ((v == F.lit(value)) & further)
        rest = (F.col("_blank") > blank) | ((F.col("_blank") == blank) & rest)
        ordered = ordered.where(rest)
    out = ordered.orderBy(*by).limit(limit)

    def cursor() -> tuple | None:
        end = out.orderBy(*[o for o in (F.col("_blank").desc(), F.col("_value").asc_nulls_first() if descending else F.col("_value").desc_nulls_first(), F.col(key).desc())]).select("_blank", "_value", key).first()
        return tuple(end) if end else None

    return out.select(*rows.columns), cursor


def page_at(rows: DataFrame, sort: str, number: int, key: str = "key", descending=False, limit: int = 50) -> DataFrame:
    """Page `number` (from 0) with the order of `page`, for pages far from the start: the rows' keys are dealt into ranges, whose counts
    tell in which ones the page lies; only those are ordered."""
    from rosterlake.tables import materialise

    ordered, by = _page_order(rows, sort, key, descending)
    ranged = ordered.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialise(ranged, "pages").withColumn("_part", F.shiftright("_at", 33))
    counts = sorted((r["_part"], r["n"], r["first"]) for r in ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first")).collect())  # a row a range
    low, high, before, wanted = number * limit, (number + 1) * limit, 0, F.lit(False)
    for _, n, first in counts:
        if before < high and before + n > low:
            wanted |= F.col("_at").between(first + max(0, low - before), first + min(n, high - before) - 1)
        before += n
    return ranged.where(wanted).orderBy("_at").select(*rows.columns)


def page_count(total: int, per_page: int) -> int:
    return max(1, -(-total // per_page))


def ordered_distinct(rows: DataFrame, value: str, pos: str) -> DataFrame:
    return rows.groupBy(value).agg(F.min(pos).alias(pos))


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """rows with the number of their batch: ordered, `size` a batch. Positions come from per-partition counts, so no one
    task sorts all rows."""
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order)
    numbered = ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    from rosterlake.tables import materialise

    numbered = materialise(numbered, "batches")
    from pyspark.sql import Window

    before = numbered.groupBy("_p").agg(F.count("*").alias("n")).withColumn("_b", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    j = numbered.join(F.broadcast(before.select("_p", "_b")), "_p")  # one row a partition
    return j.withColumn("batch", F.floor((F.col("_b") + F.col("_i")) / size).cast("long")).drop("_p", "_i", "_b")


def company_stats(rows: DataFrame) -> DataFrame:
    n = lambda c, name: F.count_if(c).alias(name)
    return rows.agg(F.count("*").alias("companies"), n(has("emails"), "with_email"), n(has("phones"), "with_phone"), n(F.map_contains_key("socials", "linkedin"), "with_linkedin"), n(_false("has_open_roles"), "hiring"))


def people_stats(rows: DataFrame, with_departed: bool) -> DataFrame:
    """with_departed False: counts of those in post, beside how many have left."""
    live = F.lit(True) if with_departed else ~_false("departed")
    n = lambda c, name: F.count_if(live & c).alias(name)
    return rows.agg(
        n(F.lit(True), "people"), n(has("emails"), "with_email"), n(has("phones"), "with_phone"), n(_false("is_coach"), "coaches"),
        n(has("emails") & ~_false("shared_email"), "direct_email"), F.count_if(_false("departed")).alias("departed"), F.count_distinct(F.when(live, F.col("school_domain"))).alias("schools"),
    )


def school_stats(rows: DataFrame) -> DataFrame:
    n = lambda c, name: F.count_if(c).alias(name)
    return rows.agg(F.count("*").alias("schools"), n(filled("athletics_domain"), "with_athletics"), n(filled("website"), "with_website"), n(filled("totalYearlyCost"), "with_cost"), n(filled("conference"), "with_conference"), n(filled("division"), "with_division"))


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """share of filled values by column, as a half-even percent."""
    sums = rows.agg(F.count("*").alias("n"), *[F.count_if(filled(c)).alias(c) for c in columns])
    long = sums.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns])).alias("x"))
    return long.select("x.field", "x.filled", percent(F.col("x.filled"), F.col("n")).alias("share"))


def facet(rows: DataFrame, values: Column, pos: str | None = None) -> DataFrame:
    """value, n over a list column."""
    return rows.select(F.explode(values).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def sport_facet(rows: DataFrame, labels: Column, small: int = 50) -> DataFrame:
    """label, base, n, base_total and whether the label is rare: groups by size, in a group the plain sport, men, women."""
    from pyspark.sql import Window

    n = rows.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n")).withColumn("base", P.sport_base(F.col("label")))
    variant = F.when(F.col("label") == F.col("base"), 0).when(F.startswith("label", F.lit("Men's")), 1).otherwise(2)
    return n.withColumn("base_total", F.sum("n").over(Window.partitionBy("base"))).withColumn("variant", variant).withColumn("rare", F.col("n") < small)


def histogram(rows: DataFrame, c: str) -> DataFrame:
    return rows.where(filled(c)).groupBy(c).agg(F.count("*").alias("n"))


def top_counts(rows: DataFrame, c: str, k: int) -> DataFrame:
    return rows.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(k)


def csv_cells(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    kinds = dict(rows.dtypes)
    return rows.select(*[cell(F.col(c), kinds[c]).alias(c) for c in columns or rows.columns])


ORIGIN = ("school", "city", "state", "division", "conference", "region", "totalYearlyCost", "academicData", "privatePublic", "country")
ACADEMIC = ("averageGPA", "SATMath", "ACTComposite", "SATReady")


def origin_shape(rows: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.try_element_at("academicData", F.lit(k)).alias("value")) for k in ACADEMIC])
    data = F.map_from_entries(F.filter(pairs, lambda e: F.coalesce(e["value"], F.lit("")) != ""))
    return rows.withColumn("academicData", data).select(*[c for c in ORIGIN if c in rows.columns])


def seed_hosts(institutions: DataFrame) -> DataFrame:
    """Each school's host to visit and where it is from: athletics host, else the website's (fallback), else missing."""
    own, site = F.when(filled("athletics_domain"), F.col("athletics_domain")), normalize_domain(F.col("website"))
    return institutions.select("key", F.coalesce(own, site).alias("host"), F.when(own.isNotNull(), "athletics").when(site.isNotNull(), "fallback").otherwise("missing").alias("origin"))


def seed_lines(sites: DataFrame) -> DataFrame:
    return sites.select(F.concat(F.col("domain"), F.lit("  # "), F.col("status"), F.when(filled("detail"), F.concat(F.lit(": "), F.col("detail"))).otherwise(F.lit(""))).alias("line"))


def cache_path(url: Column) -> Column:
    h = F.sha2(url.cast("binary"), 256)
    return F.concat(F.substring(h, 1, 2), F.lit("/"), h, F.lit(".json"))


def log_lines(rows: DataFrame, kind: str) -> DataFrame:
    """What a run says of each row: label, sublabel and a summary, by entity (company, person or institution)."""
    first = lambda c: F.get(F.col(c), 0)
    shown = lambda c: F.when(filled(c), F.col(c))
    if kind == "institution":
        label, sub, bits, none = "school", "conference", [shown("division"), shown("state"), shown("totalYearlyCost")], "no details"
    else:
        label, sub, extra = ("domain", "company_name", "location") if kind == "company" else ("name", "title", "sport")
        bits, none = [first("emails"), first("phones"), F.substring(shown(extra), 1, 30)], "no contact details"
    said = F.concat_ws(" | ", *bits)
    return rows.select("key", F.col(label).alias("label"), F.coalesce(F.col(sub), F.lit("")).alias("sublabel"), F.when(said == "", none).otherwise(said).alias("summary"))
