"""Ordered upsert-merge: rows of one key fold, in the order of a sequence, into one row.

Every rule is associative, so a key is grouped aggregation and no row-at-a-time fold: newest non-empty is a max_by over
the sequence; of unions and maps each different value (or map key) is first reduced to the place where it was first met and, for
maps, the value it had last, so that only what differs is collected for a key. A key seen once passes through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions.text import null_blank, packed
from rosterlake.schemas import EntitySpec


def _filled(c: str, kind: str) -> Column:
    if kind == "string":
        return F.col(c).isNotNull() & (F.col(c) != "")
    if kind in ("int", "bigint"):
        return F.col(c).isNotNull() & (F.col(c) != 0)
    return F.col(c).isNotNull()


def _newest(c: str, seq: str, filled: Column) -> Column:
    """Value of the latest row where it is filled; if there is none, that of the first row."""
    return F.coalesce(F.max_by(F.when(filled, F.col(c)), F.when(filled, F.col(seq))), F.min_by(c, seq))


def _ordered(c: str, seq: str) -> Column:
    """Values of c in order, for groups that are small by nature (the pages of a site)."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(c).alias("v")))), lambda x: x["v"])


_PART = "array<struct<c:string,k:string,v:string,i:int>>"


def _parts(rows: DataFrame, spec: EntitySpec, seq: str, key: str) -> DataFrame | None:
    """key -> _parts: of each union, packed or map column the different values or map keys, where each was first met and, of
    a map key, its last value."""
    kinds = dict(rows.dtypes)
    void = F.lit(None).cast("string")

    def listed(c: str, values: Column) -> Column:
        return F.transform(values, lambda x, i: F.struct(F.lit(c).alias("c"), x.alias("k"), void.alias("v"), i.alias("i")))

    def mapped(c: str, keep) -> Column:
        return F.transform(F.filter(F.map_entries(c), keep), lambda e, i: F.struct(F.lit(c).alias("c"), e["key"].alias("k"), e["value"].alias("v"), i.alias("i")))

    lists = [listed(c, F.filter(F.col(c), lambda x: x.isNotNull() & (x != ""))) for c in spec.union if c in kinds]
    lists += [listed(c, packed(F.col(c))) for c in spec.join_unique if c in kinds]
    lists += [mapped(c, lambda e: F.lit(True)) for c in spec.overlay if c in kinds]
    lists += [mapped(c, lambda e: F.coalesce(e["value"], F.lit("")) != "") for c in spec.overlay_filled if c in kinds]
    if not lists:
        return None
    each = rows.select(key, F.col(seq).alias("_s"), F.explode(F.concat(*[F.coalesce(x, F.array().cast(_PART)) for x in lists])).alias("p"))
    each = each.groupBy(key, F.col("p.c").alias("c"), F.col("p.k").alias("k")).agg(F.min(F.struct("_s", "p.i")).alias("at"), F.max_by("p.v", "_s").alias("v"))
    return each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("c", "at", "k", "v"))).alias("_parts"))


def merge(rows: DataFrame, spec: EntitySpec, seq: str = "seq", key: str = "key", marks: dict[str, Column] | None = None) -> DataFrame:
    """rows with a total order `seq` -> one row per key: key, merged columns, _n (rows folded), and what aggregates
    `marks` names."""
    if key not in rows.columns:
        rows = rows.withColumn(key, spec.key if isinstance(spec.key, Column) else F.col(spec.key))
    kinds = dict(rows.dtypes)
    has = lambda names: [c for c in names if c in kinds]
    aggs = [F.count("*").alias("_n")]
    aggs += [_newest(c, seq, _filled(c, kinds[c])).alias(c) for c in has(spec.newest)]
    aggs += [_newest(c, seq, F.col(c).isNotNull()).alias(c) for c in has(spec.newest_known)]
    aggs += [F.first(c).alias(c) for c in has(spec.join_unique + spec.union + spec.overlay + spec.overlay_filled)]
    aggs += [F.bool_or(c).alias(c) for c in has(spec.any_)]
    aggs += [F.min(c).alias(c) for c in has(spec.least)]
    aggs += [F.max(c).alias(c) for c in has(spec.greatest)]
    aggs += [F.min_by(c, seq).alias(f"_{c}") for c in spec.reset if c in kinds]
    aggs += [c.alias(name) for name, c in (marks or {}).items()]
    out = rows.groupBy(key).agg(*aggs)
    parts = _parts(rows, spec, seq, key)
    if parts is not None:
        out = out.join(parts.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left")
        mine = lambda c, f: F.transform(F.filter("_parts", lambda x: x["c"] == c), f)
        met = lambda c: F.coalesce(mine(c, lambda x: x["k"]), F.array().cast("array<string>"))
        laid = lambda c: F.coalesce(F.map_from_entries(mine(c, lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value")))), F.create_map().cast("map<string,string>"))
        once = lambda c, value: F.when(F.col("_n") == 1, F.col(c)).otherwise(value)
        for c in has(spec.join_unique):
            out = out.withColumn(c, once(c, null_blank(F.array_join(met(c), "; "))))
        for c in has(spec.union):
            out = out.withColumn(c, once(c, met(c)))
        for c in has(spec.overlay):
            out = out.withColumn(c, laid(c))
        for c in has(spec.overlay_filled):
            out = out.withColumn(c, once(c, laid(c)))
    for c, value in spec.reset.items():
        if c in kinds:
            out = out.withColumn(c, F.when(F.col("_n") == 1, F.col(f"_{c}")).otherwise(value)).drop(f"_{c}")
    order = [c for c in rows.columns if c in out.columns and c != key]
    return out.select(key, *order, "_n", *(marks or {}))


def change_log(stored: DataFrame, incoming: DataFrame, key: str = "key") -> DataFrame:
    """What an upsert does to each key: new, updated, returned (a departed one met again) or kept."""
    old = stored.groupBy(key).agg(F.bool_or("departed").alias("_gone")) if "departed" in stored.columns else stored.select(key).distinct().withColumn("_gone", F.lit(False))
    new = incoming.select(key).distinct().withColumn("_in", F.lit(True))
    j = old.withColumn("_old", F.lit(True)).join(new, key, "full_outer")
    return j.select(key, F.when(F.col("_old").isNull(), "new").when(F.col("_in").isNull(), "kept").when(F.col("_gone"), "returned").otherwise("updated").alias("change"))


def run_counters(log: DataFrame) -> DataFrame:
    n = lambda what: F.count_if(F.col("change") == what).alias(what)
    return log.agg(n("new"), n("updated"), n("returned"), n("kept"))


def dedupe_page(rows: DataFrame, spec: EntitySpec, page: str = "page_id", pos: str = "pos") -> DataFrame:
    """Equal keys on one page folded in page order."""
    keyed = rows.withColumn("_k", spec.key).withColumn("key", F.struct(F.col(page).alias("page"), F.col("_k").alias("k")))
    out = merge(keyed.drop("_k"), spec, seq=pos)
    return out.withColumn(page, F.col("key.page")).withColumn("key", F.col("key.k"))


def rekey(rows: DataFrame, spec: EntitySpec, old_key: str = "key") -> DataFrame:
    """Keys derived anew after a repair; rows that now share one fold in the order of their old keys."""
    seq = rows.withColumn("seq", F.col(old_key)).drop(old_key)
    return merge(seq, spec)


def shared_emails(people: DataFrame, at_least: int = 3, page: str = "school_domain", key: str = "key") -> DataFrame:
    """people with shared_email set where every address is one that at_least people of the page have."""
    each = people.select(page, key, F.explode(F.array_distinct("emails")).alias("email"))
    wide = each.groupBy(page, "email").agg(F.count_distinct(key).alias("n"))
    flag = each.join(wide, [page, "email"]).groupBy(page, key).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    out = people.join(flag, [page, key], "left")
    shared = F.coalesce(F.col("least") >= at_least, F.lit(False))
    prior = F.coalesce(F.col("shared_email"), F.lit(False)) if "shared_email" in people.columns else F.lit(False)
    return out.withColumn("shared_email", prior | shared).drop("least", "most")


def forward_fill(rows: DataFrame, value: str, by: str | list[str], pos: str) -> DataFrame:
    """value carried on over the rows after it, within `by` (one document, page or table)."""
    w = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))
