"""Institutions: divisions, regions, levels, names, costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlake.functions import vocabulary as V
from rosterlake.functions.text import clean, lookup, null_blank, slug, squeeze, strip, strip_edge


def normalize_division(value: Column) -> Column:
    t = squeeze(F.upper(F.coalesce(value, F.lit(""))))
    return (
        F.when((t == "") | t.isin(*V.SELF_NAMED_DIVISIONS), t)
        .when(t == "DNAIA", "NAIA")
        .when(F.startswith(t, F.lit("NJCAA")), "NJCAA")
        .when(F.startswith(t, F.lit("D")), t)
        .otherwise(F.concat(F.lit("D"), t))
    )


def state_code(value: Column) -> Column:
    t = strip(value)
    code = F.upper(t)
    return F.when((F.length(t) == 2) & code.isin(*V.STATES), code).otherwise(lookup(F.lower(t), {v.lower(): k for k, v in V.STATES.items()}))


def state_name(value: Column) -> Column:
    return lookup(state_code(value), V.STATES)


def region_for(value: Column) -> Column:
    return lookup(state_code(value), {code: region for region, codes in V.REGIONS.items() for code in codes})


def association_for(division: Column) -> Column:
    d = F.upper(F.coalesce(division, F.lit("")))
    return F.when(F.contains(d, F.lit("NJCAA")), "NJCAA").when(F.contains(d, F.lit("NAIA")), "NAIA").when(d.isin("CCCAA", "NWAC"), d).when(F.startswith(d, F.lit("D")), "NCAA")


def normalize_name(name: Column) -> Column:
    """A school name reduced to what two lists agree on; only ever used with the state."""
    n = F.replace(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit(" and ")), F.lit("-"), F.lit(" "))
    n = F.regexp_replace(n, r"\b(the|of|at)\b", " ")
    return squeeze(F.regexp_replace(n, "[^a-z0-9 ]+", " "))


def fuzzy_key(name: Column) -> Column:
    n = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\b(?:the|university|college|campus|of|at|and)\b", " ")
    return strip(F.regexp_replace(n, "[^a-z0-9]+", " "))


def search_term(name: Column) -> Column:
    """Up to three distinctive leading words."""
    head = F.get(F.split(name, r"[,(]"), 0)
    head = F.regexp_replace(head, r"(?i)\b(?:the|university|college|of|at)\b", " ")
    words = F.filter(F.split(F.regexp_replace(head, r"(?U)[^\w\s'-]", " "), r"\s+"), lambda w: w != "")
    return F.coalesce(null_blank(F.array_join(F.slice(words, 1, 3), " ")), name)


def level(value: Column) -> Column:
    """struct<association, division> of a level text: exact, else the longest known level it starts with."""
    key = squeeze(F.lower(F.coalesce(value, F.lit(""))))
    out = F.when(F.lit(False), F.struct(F.lit("").alias("association"), F.lit("").alias("division")))
    for name in sorted(V.LEVELS, key=len, reverse=True):
        a, d = V.LEVELS[name]
        out = out.when(F.startswith(key, F.lit(name)), F.struct(F.lit(a).alias("association"), F.lit(d).alias("division")))
    return out.otherwise(F.struct(F.lit("").alias("association"), F.lit("").alias("division")))


def juco_body(conference: Column) -> Column:
    out = None
    for name, pattern in V.JUCO_BODIES.items():
        hit = F.coalesce(conference, F.lit("")).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def naia_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)^(.*),\s*(University|College)(?:\s+of)?$", "$2 of $1")


def link_text(target: Column) -> Column:
    return strip(F.when(F.contains(target, F.lit("|")), F.regexp_replace(target, r"^[^|]*\|", "")).otherwise(F.substring_index(target, "#", 1)))


def money(value: Column) -> Column:
    return F.when(value > 0, F.concat(F.lit("$"), F.format_number(value, 0)))


def yearly_cost(attendance: Column, in_state: Column, out_state: Column, ownership: Column) -> Column:
    """One figure, or in-state/out-of-state where a public school charges more out of state."""
    extra = F.greatest(F.lit(0), out_state - in_state)
    pair = (ownership == 1) & in_state.isNotNull() & out_state.isNotNull() & (extra > 0)
    return F.when(attendance > 0, F.when(pair, F.concat_ws("/", money(attendance), money(attendance + extra))).otherwise(money(attendance)))


def score_range(low: Column, high: Column) -> Column:
    return F.when(low.isNotNull() & high.isNotNull(), F.concat_ws("-", low.cast("int").cast("string"), high.cast("int").cast("string")))


def academic_data(ranges: dict[str, Column]) -> Column:
    pairs = F.create_map(*[x for k, c in ranges.items() for x in (F.lit(k), c)])
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def private_public(ownership: Column, flag: Column) -> Column:
    return F.coalesce(lookup(ownership.cast("int"), V.OWNERSHIP), F.when(flag == "Y", V.OWNERSHIP[2]).when(flag == "N", V.OWNERSHIP[1]))


def member_division(roman: Column, number: Column) -> Column:
    return F.coalesce(lookup(strip(roman), V.DIVISION_CODES), lookup(strip(number.cast("string")), V.DIVISION_CODES))


def member_host(url: Column) -> Column:
    h = F.substring_index(F.regexp_replace(F.lower(strip(url)), "^https?://", ""), "/", 1)
    return null_blank(F.regexp_replace(h, r"^www\.", ""))


def clean_school_name(raw: Column) -> Column:
    """A page title without what athletics sites wrap around an institution's name."""
    n = F.regexp_replace(squeeze(raw), V.SCHOOL_TITLE_PREFIX, "")
    parts = F.filter(F.transform(F.split(n, r"\s+[|–—-]\s+"), strip), lambda p: (p != "") & ~p.rlike(V.SCHOOL_TITLE_SEGMENT))
    n = F.when(F.size(parts) > 0, F.array_join(parts, " - ")).otherwise(n)
    short = F.regexp_replace(n, r"(?i)\s+athletics?$", "")
    n = F.when((short != n) & short.rlike(V.SCHOOL_KIND), short).otherwise(n)
    return null_blank(strip_edge(n, " -|"))


def school_title(raw: Column) -> Column:
    """Null for a title that describes the page and not the institution."""
    return F.when(~strip(clean(raw)).rlike(V.NOT_A_SCHOOL), clean_school_name(raw))


def school_key(org_id: Column, school: Column, state: Column, country: Column, association: Column) -> Column:
    place = F.regexp_replace(F.lower(F.coalesce(null_blank(state), country)), " ", "-")
    return F.when(org_id.isNotNull(), F.concat(F.lit("ncaa:"), org_id.cast("string"))).otherwise(F.concat_ws("|", null_blank(slug(school)), null_blank(place), null_blank(F.lower(association))))
