"""Text and collection functions, each Column to Column, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def null_blank(c: Column) -> Column:
    return F.when(c != "", c)


def clean(c: Column) -> Column:
    """Whitespace squeezed; null if nothing is left."""
    return null_blank(squeeze(c))


def strip_edge(c: Column, chars: str) -> Column:
    """Without the given characters at both ends."""
    return F.btrim(c, F.lit(chars))


def lookup(c: Column, table: dict, default: Column | None = None) -> Column:
    """A literal table, for the few dozen codes we have."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, c)
    return found if default is None else F.coalesce(found, default)


def slug(c: Column) -> Column:
    return strip_edge(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "-")


def squash(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def packed(c: Column, sep: str = ";") -> Column:
    """The parts of a packed string, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), strip), lambda x: x != "")


def join_unique(*cs: Column) -> Column:
    """Packed strings as one, each part once, in order of first appearance; null if empty."""
    parts = F.array_distinct(F.concat(*[packed(c) for c in cs]))
    return null_blank(F.array_join(parts, "; "))


def union_lists(*cs: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(*[F.coalesce(c, empty) for c in cs]), lambda x: x.isNotNull() & (x != "")))


def percent(part: Column, whole: Column) -> Column:
    """Half-even whole percent with a sign; 0% of nothing."""
    return F.concat(F.when(whole == 0, F.lit(0)).otherwise(F.bround(100.0 * part / whole, 0).cast("int")).cast("string"), F.lit("%"))


def contains_any(c: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in needles])


def cell(c: Column, kind: str) -> Column:
    """A value as a CSV cell: lists and maps joined by '; ', booleans as True and False, null as blank."""
    if kind.startswith("array"):
        out = F.array_join(F.transform(c, lambda x: x.cast("string")), "; ")
    elif kind.startswith("map"):
        out = F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), "; ")
    elif kind == "boolean":
        out = F.initcap(c.cast("string"))
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def is_blank(c: Column, kind: str) -> Column:
    """Null, empty text, empty list, empty map, or a list that starts with a blank; False and 0 aren't blank."""
    if kind.startswith("array"):
        return F.coalesce(F.coalesce(F.get(c, 0).cast("string"), F.lit("")) == "", F.lit(True))
    if kind.startswith("map"):
        return F.coalesce(F.coalesce(F.get(F.map_values(c), 0).cast("string"), F.lit("")) == "", F.lit(True))
    if kind == "string":
        return F.coalesce(c, F.lit("")) == ""
    return c.isNull()


def sort_value(c: Column, kind: str) -> Column:
    """What a column sorts by: text lower-cased, a list's or map's first value, a number or boolean as such."""
    if kind.startswith("array"):
        return F.lower(F.get(c, 0).cast("string"))
    if kind.startswith("map"):
        return F.lower(F.get(F.map_values(c), 0).cast("string"))
    return F.lower(c) if kind == "string" else c
