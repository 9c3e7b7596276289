"""Exports: CSV, JSON, text and partitioned snapshots. All are written by executors; one file only where asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.operators.lookups import with_division
from rosterlake.operators.queries import csv_cells, origin_shape, seed_lines


def export(rows: DataFrame, path: str, columns: list[str] | None = None, single: bool = False, bom: bool = False) -> None:
    """By the path's suffix: .csv cells with a header, .json lines, .parquet. bom puts a byte order mark before a CSV's header,
    as spreadsheets like it; columns that rows don't have are left out."""
    out = rows.select(*[c for c in columns if c in rows.columns]) if columns else rows
    out = out.coalesce(1) if single else out
    if path.endswith(".csv"):
        cells = csv_cells(out)
        if bom:
            cells = cells.toDF(f"\ufeff{cells.columns[0]}", *cells.columns[1:])
        cells.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif path.endswith(".json"):
        out.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    elif path.endswith(".parquet"):
        out.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"no format for {path}")


def export_people(people: DataFrame, institutions: DataFrame, path: str, columns: list[str] | None = None, **options) -> None:
    """People with the division of their school, looked up by host."""
    export(with_division(people, institutions), path, [*columns, "division"] if columns else None, **options)


def export_store(rows: DataFrame, path: str, updated_at: str) -> None:
    """A store's rows by key as {updated_at, count} beside leads, and the same as a CSV."""
    from pyspark.sql import functions as F

    ordered = rows.orderBy("key")
    rows.agg(F.count("*").alias("count")).select(F.lit(updated_at).alias("updated_at"), "count").coalesce(1).write.mode("overwrite").json(f"{path}/about")
    export(ordered, f"{path}/leads.json")
    export(ordered, f"{path}/leads.csv", bom=True)


def export_institutions(rows: DataFrame, path: str) -> None:
    export(origin_shape(rows), path)


def run_snapshot(rows: DataFrame, path: str, run_id: str) -> None:
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def outcome_files(sites: DataFrame, path: str) -> None:
    """report, succeeded and failed, the last two as seed files."""
    sites.write.mode("overwrite").json(f"{path}/sites")
    seed_lines(sites.where("status = 'ok'")).write.mode("overwrite").text(f"{path}/succeeded")
    seed_lines(sites.where("status <> 'ok'")).write.mode("overwrite").text(f"{path}/failed")


def photo_path(domain, name, url):
    """Where a photo goes: a folder for the host, the name's slug, the picture's suffix."""
    from rosterlake.functions.text import slug

    suffix = F.lower(F.regexp_extract(url, r"(\.(?:jpe?g|png|gif|webp))(?:$|\?)", 1))
    return F.concat(F.regexp_replace(domain, "[^A-Za-z0-9.-]+", "_"), F.lit("/"), slug(name), F.when(suffix != "", suffix).otherwise(F.lit(".jpg")))
