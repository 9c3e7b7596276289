"""Stores, seeds, saved pages, spreadsheets, run reports and the response cache."""

from __future__ import annotations

import functools
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.functions import schools as S
from rosterlake.functions import vocabulary as V
from rosterlake.functions.text import null_blank, strip
from rosterlake.functions.web import normalize_domain
from rosterlake.schemas import OUTCOME, EntitySpec
from rosterlake.sources import source
from rosterlake.sources.json_array import read_objects


def quarantine(spark: SparkSession, path: str) -> str | None:
    """Move a store file that isn't JSON of a store aside, to path.corrupt.json, so that the next save doesn't bury it; the new
    path, or None if the file is sound or not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    text = spark.read.text(path, wholetext=True)
    shape = T.StructType([T.StructField("leads", T.ArrayType(T.StringType())), T.StructField("_bad", T.StringType())])
    bare = F.startswith(F.ltrim("value"), F.lit("["))
    wrapped = F.when(bare, F.concat(F.lit('{"leads":'), "value", F.lit("}"))).otherwise(F.col("value"))
    bad = text.select(F.from_json(wrapped, shape, {"columnNameOfCorruptRecord": "_bad"}).alias("s")).where("s is null or s._bad is not null").limit(1).count()
    if not bad:
        return None
    aside = f"{path.removesuffix('.json')}.corrupt.json"
    fs.rename(at, spark._jvm.org.apache.hadoop.fs.Path(aside))
    return aside


@source("store")
def read_store(spark: SparkSession, path: str, spec: EntitySpec, lines: bool = False) -> DataFrame:
    """A store file, {"leads": [...]} or a bare list: unknown fields dropped, rows without a required field skipped, the
    last of equal keys kept; an unreadable file is an empty store. Either is read in splits; with lines, path holds one
    JSON row a line, as exports write it."""
    if lines:
        rows = spark.read.schema(spec.schema).json(path).withColumn("pos", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
        return _store_rows(rows, spec)
    parsed = read_objects(spark, path).select(F.struct("file", "pos").alias("pos"), F.from_json("value", spec.schema, {"mode": "PERMISSIVE"}).alias("r"))
    return _store_rows(parsed.where("r is not null").select("pos", "r.*"), spec)


def _store_rows(rows: DataFrame, spec: EntitySpec) -> DataFrame:
    if spec.name == "institution":
        rows = rows.withColumn("association", F.coalesce(null_blank(F.col("association")), S.association_for(F.col("division"))))
    for c in spec.required:
        rows = rows.where(F.col(c).isNotNull())
    keyed = rows.withColumn("key", spec.key)
    cols = [f.name for f in spec.schema]
    return keyed.groupBy("key").agg(F.max_by(F.struct(*cols), "pos").alias("r")).select("key", "r.*")


def domains_of(lines: DataFrame, text: Column, pos: Column) -> DataFrame:
    bare = strip(F.regexp_replace(F.regexp_replace(text, "﻿", ""), "#.*$", ""))
    return lines.select(normalize_domain(bare).alias("domain"), pos.alias("pos")).where("domain is not null").groupBy("domain").agg(F.min("pos").alias("pos"))


@source("seeds")
def read_seeds(spark: SparkSession, path: str | None = None, first: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """domain, pos: values given directly, then those of a text file; comments, blanks and repeats dropped, order kept."""
    parts = []
    if first:
        parts.append(spark.createDataFrame([(i, v) for i, v in enumerate(first)], "i long, value string").select(F.col("value"), F.struct(F.lit(0).alias("f"), F.col("i").alias("i"))).toDF("value", "pos"))
    if path:
        lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "value"))
        parts.append(lines.select("value", F.struct(F.lit(1).alias("f"), F.col("i").cast("long").alias("i"))).toDF("value", "pos"))
    if not parts:
        return spark.createDataFrame([], "domain string, pos struct<f:int,i:long>")
    rows = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    out = domains_of(rows, F.col("value"), F.col("pos")).orderBy("pos")
    return out.limit(limit) if limit is not None else out


@source("saved_html")
def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """path/<host>/*.html -> domain, file, html; bytes that aren't UTF-8 are replaced, files outside a host folder ignored."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.htm*").option("recursiveFileLookup", "true").load(path)
    rows = raw.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"))
    return rows.select(normalize_domain(F.col("folder")).alias("domain"), "file", "html").where("domain is not null")


def _cells(content: bytes) -> list[tuple[str, int, list[str | None]]]:
    """(sheet, pos, cells) of a workbook, which is a zip of XML: shared strings, inline strings, numbers as written."""
    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    under = lambda e, name: [x for x in e.iter() if tag(x) == name]
    said = lambda e: "".join(x.text or "" for x in under(e, "t"))
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        load = lambda path: ElementTree.fromstring(z.read(path))
        shared = [said(x) for x in under(load("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in load("xl/_rels/workbook.xml.rels")}
        for s in under(load("xl/workbook.xml"), "sheet"):
            rel = next(v for k, v in s.attrib.items() if k.endswith("}id"))
            path = targets[rel].lstrip("/")
            for n, row in enumerate(under(load(path if path.startswith("xl/") else f"xl/{path}"), "row"), 1):
                cells: list[str | None] = []
                for c in under(row, "c"):
                    letters = re.match("[A-Z]*", c.get("r", "")).group()
                    at = functools.reduce(lambda k, x: k * 26 + ord(x) - 64, letters, 0) - 1 if letters else len(cells)
                    cells += [None] * (at - len(cells))
                    value = next((x.text for x in under(c, "v")), None)
                    cells.append(said(c) if c.get("t") == "inlineStr" else shared[int(value)] if c.get("t") == "s" and value is not None else value)
                out.append((s.get("name"), int(row.get("r", n)), cells))
    return out


@source("workbook")
def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """XLSX files -> file, sheet, pos, cells (text; empty ones null). A workbook is one task's, as its parts refer to each other;
    one that can't be read has no rows."""

    def run(batches):
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows += [(file, *r) for r in _cells(content)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, StopIteration, IndexError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["file", "sheet", "pos", "cells"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return raw.select("path", "content").mapInPandas(run, "file string, sheet string, pos int, cells array<string>")


def workbook_sheet(rows: DataFrame, sheet: str | None = None) -> DataFrame:
    """A sheet of read_workbook (the first, if not named) whose first line are its headers, as read_sheet gives it."""
    one = rows.where(F.col("sheet") == sheet) if sheet else rows.join(rows.agg(F.min_by("sheet", F.struct("file", "pos")).alias("sheet")), "sheet", "left_semi")
    head = one.orderBy("file", "pos").first()
    if head is None:
        raise ValueError("no such sheet")
    body = one.where((F.col("file") == head["file"]) & (F.col("pos") > head["pos"]))
    return alias_columns(body.select(*[F.get("cells", i).alias(c) for i, c in enumerate(head["cells"]) if c]))


@source("sheet")
def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with headers by alias -> school, level, conference, state, city, link as far as it has them; blanks null."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    return alias_columns(raw)


def alias_columns(raw: DataFrame) -> DataFrame:
    picked: dict[str, str] = {}
    for c in raw.columns:
        field = V.SHEET_ALIASES.get(re.sub("[^a-z0-9]+", "", c.lower().replace("﻿", "")))
        if field:
            picked.setdefault(field, c)
    if "school" not in picked:
        raise ValueError("no column names the school")
    return raw.select(*[null_blank(strip(F.col(f"`{c}`"))).alias(f) for f, c in picked.items()]).where("school is not null")


def institution_rows(sheet: DataFrame) -> DataFrame:
    """Spreadsheet rows as institutions."""
    opt = lambda c: F.col(c) if c in sheet.columns else F.lit(None).cast("string")
    lv, body = S.level(opt("level")), S.juco_body(opt("conference"))
    juco = lv["association"] == "NJCAA"
    return sheet.select(
        "school", opt("city").alias("city"), S.state_name(opt("state")).alias("state"), S.region_for(opt("state")).alias("region"), opt("conference").alias("conference"),
        F.when(juco & body.isNotNull(), body).otherwise(null_blank(lv["association"])).alias("association"), F.when(juco & body.isNotNull(), body).otherwise(null_blank(lv["division"])).alias("division"),
        normalize_domain(opt("link")).alias("athletics_domain"),
    )


def positional_sheet(rows: DataFrame, columns: dict[str, int], marker: str = "Conference") -> DataFrame:
    """rows(sheet, pos, cells array): those after the sheet's marker row, by position; '-', '--' and 'n/a' are null."""
    mark = rows.where(F.exists("cells", lambda c: F.trim(c) == marker)).groupBy("sheet").agg(F.min("pos").alias("m"))
    value = lambda i: F.when(~F.lower(F.trim(F.get("cells", i))).isin("", "-", "--", "n/a"), F.trim(F.get("cells", i)))
    return rows.join(mark, "sheet").where("pos > m").select("sheet", "pos", *[value(i).alias(n) for n, i in columns.items()])


def workbook_urls(rows: DataFrame) -> DataFrame:
    """rows(pos, school, state, landing): (name, state) -> the first landing page."""
    ok = rows.where(F.startswith("landing", F.lit("http")))
    return ok.groupBy(S.normalize_name(F.col("school")).alias("name"), F.lower("state").alias("state")).agg(F.min_by("landing", "pos").alias("url"))


def blocked_seeds(lines: DataFrame) -> DataFrame:
    """lines(pos, value) like `host # School (State)` -> name, state, host; the first of a school wins."""
    pat = r"^\s*(\S+)\s*#\s*(.+?)\s*\(([^()]*)\)\s*$"
    rows = lines.select("pos", *[F.regexp_extract("value", pat, i).alias(n) for i, n in ((1, "host"), (2, "school"), (3, "state"))]).where("host <> ''")
    return rows.groupBy(S.normalize_name(F.col("school")).alias("name"), F.lower("state").alias("state")).agg(F.min_by("host", "pos").alias("host"))


@source("run_reports")
def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """path/<run>/sites.json, a list or {"sites": [...]} -> run_id, pos and the outcome columns; unreadable files skipped."""
    raw = spark.read.text(f"{path}/*/sites.json", wholetext=True).select("value", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("run_id"))
    wrapped = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.concat(F.lit('{"sites":'), "value", F.lit("}"))).otherwise(F.col("value"))
    got = raw.select("run_id", F.from_json(wrapped, T.StructType([T.StructField("sites", T.ArrayType(OUTCOME))])).alias("s"))
    return got.select("run_id", F.posexplode("s.sites").alias("pos", "o")).where("o.domain is not null").select("run_id", "pos", "o.*")


META = "run_id string, source string, leads int, new int, updated int, returned int, seconds double"


@source("run_metas")
def read_metas(spark: SparkSession, path: str) -> DataFrame:
    """Newest first, with whether the run has a report."""
    run = lambda: F.element_at(F.split("_metadata.file_path", "/"), -2)
    meta = spark.read.text(f"{path}/*/meta.json", wholetext=True).select(run().alias("run"), F.from_json("value", META).alias("m"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "sites.json").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -2).alias("run"))
    return meta.join(files.withColumn("has_report", F.lit(True)), "run", "left").select("run", "m.*", F.coalesce("has_report", F.lit(False)).alias("has_report")).orderBy(F.desc("run"))


def run_id_ok(run_id: str) -> bool:
    """Whether a run id can be a folder of the runs folder and nothing else."""
    return bool(run_id) and not run_id.startswith(".") and "/" not in run_id and "\\" not in run_id


def live_cache(entries: DataFrame, now: float, ttl: float = 604_800) -> DataFrame:
    """The last stored response of each URL that is still fresh and may be kept."""
    ok = entries.where(F.col("status").isin(*V.CACHEABLE) & (F.lit(now) - F.col("fetched_at") <= ttl))
    return ok.groupBy("url").agg(F.max_by(F.struct(*[c for c in entries.columns if c != "url"]), "fetched_at").alias("r")).select("url", "r.*")


def cache_write(responses: DataFrame, path: str) -> None:
    """Responses that may be kept, the last of each URL, by the first two digits of the URL's hash."""
    from rosterlake.operators.queries import cache_path

    ok = responses.where(F.col("status").isin(*V.CACHEABLE))
    last = ok.groupBy("url").agg(F.max_by(F.struct(*[c for c in responses.columns if c != "url"]), "fetched_at").alias("r")).select("url", "r.*")
    last.withColumn("bucket", F.substring(cache_path(F.col("url")), 1, 2)).write.mode("append").partitionBy("bucket").parquet(path)


def purge(entries: DataFrame, now: float, ttl: float = 604_800) -> DataFrame:
    """Entries without those past their time; entries that can't be read (no URL or time) go too."""
    return entries.where(F.col("url").isNotNull() & (F.lit(now) - F.col("fetched_at") <= ttl))


def purge_counts(entries: DataFrame, now: float, ttl: float = 604_800) -> DataFrame:
    old = F.lit(now) - F.col("fetched_at") > ttl
    return entries.agg(F.count_if(old).alias("expired"), F.count_if(~old).alias("live"))


def cache_counters(asked: DataFrame, entries: DataFrame, now: float, ttl: float = 604_800) -> DataFrame:
    hit = asked.join(live_cache(entries, now, ttl).select("url").withColumn("_h", F.lit(1)), "url", "left")
    return hit.agg(F.count_if(F.col("_h").isNotNull()).alias("hits"), F.count_if(F.col("_h").isNull()).alias("misses"))


