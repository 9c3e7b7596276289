"""Member lists of associations: API records, list text, wiki text."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions import schools as S
from rosterlake.functions import vocabulary as V
from rosterlake.functions.text import lookup, null_blank, strip
from rosterlake.operators.merge import forward_fill
from rosterlake.sources import source

RECORD = (
    "nameOfficial string, conferenceName string, divisionRoman string, division int, athleticWebUrl string, webSiteUrl string, privateFlag string, deactive string, association string, "
    "city string, orgId int, memberOrgAddress struct<state:string>"
)


@source("member_api")
def read_members(spark: SparkSession, paths: list[str]) -> DataFrame:
    """JSON arrays of member records, one file a division, united; deactivated members dropped."""
    parts = [spark.read.schema(RECORD).option("multiLine", True).json(p) for p in paths]
    return reduce(DataFrame.unionByName, parts).where(F.coalesce("deactive", F.lit("")) != "Y")


def as_institutions(members: DataFrame) -> DataFrame:
    state = null_blank(strip(F.col("memberOrgAddress.state")))
    return members.select(
        F.col("nameOfficial").alias("school"), "city", S.state_name(state).alias("state"), S.region_for(state).alias("region"), S.member_division(F.col("divisionRoman"), F.col("division")).alias("division"),
        F.col("conferenceName").alias("conference"), S.member_host(F.col("athleticWebUrl")).alias("athletics_domain"), F.col("webSiteUrl").alias("website"),
        S.private_public(F.lit(None), F.col("privateFlag")).alias("privatePublic"), F.col("orgId").alias("ncaa_org_id"), F.coalesce("association", F.lit("NCAA")).alias("association"),
    )


def member_lines(lines: DataFrame) -> DataFrame:
    """lines(pos, value) `Name – ST  CONF` -> pos, school, state, conference; the first of a name and state."""
    t = strip(F.col("value"))
    rows = lines.where(~F.contains("value", F.lit("NATIONAL ASSOCIATION")) & ~F.startswith(t, F.lit("Last Modified")))
    rows = rows.select("pos", *[F.regexp_extract(t, V.MEMBER_LINE, i).alias(n) for i, n in ((1, "name"), (2, "state"), (3, "code"))])
    rows = rows.withColumn("name", F.trim(F.regexp_replace(F.trim("name"), r"\*+$", ""))).where("name <> ''")
    first = rows.groupBy("name", "state").agg(F.min(F.struct("pos", "code")).alias("r"))
    return first.select("r.pos", S.naia_name(F.col("name")).alias("school"), "state", lookup(F.trim("r.code"), V.NAIA_CONFERENCES, F.trim("r.code")).alias("conference"))


def stated_total(lines: DataFrame, pattern: str = V.MEMBER_TOTAL) -> DataFrame:
    return lines.select(F.regexp_extract("value", pattern, 1).alias("n")).where("n <> ''").agg(F.max(F.col("n").cast("int")).alias("stated"))


def wiki_members(lines: DataFrame, division: str, by: str) -> DataFrame:
    """lines(by, pos, value), by naming the article -> pos, school, city, state: linked bullets under state headings, the first
    of a name and state. linked is False for bullets without a link, whose name can't be told from the nickname."""
    t = strip(F.col("value"))
    rows = lines.withColumn("line", t).withColumn("state", null_blank(F.trim(F.regexp_extract(t, V.WIKI_HEADING, 1))))
    rows = forward_fill(rows, "state", by, "pos").where(F.startswith("line", F.lit("*")) & F.col("state").isNotNull() & ~F.col("line").rlike(V.WIKI_REFERENCE))
    rest = F.regexp_extract("line", V.WIKI_ENTRY, 2)
    city = F.coalesce(*[null_blank(F.regexp_extract(rest, V.WIKI_CITY, i)) for i in (2, 1, 3)])
    code = F.coalesce(S.state_code(F.col("state")), F.col("state"))
    rows = rows.select(
        "pos", null_blank(S.link_text(F.regexp_extract("line", V.WIKI_ENTRY, 1))).alias("school"), null_blank(F.trim(F.substring_index(city, ",", 1))).alias("city"), code.alias("state"),
        null_blank(F.trim(F.regexp_extract("line", V.WIKI_PLAIN, 1))).alias("plain"),
    )
    linked = rows.where("school is not null").groupBy("school", "state").agg(F.min(F.struct("pos", "city")).alias("r")).select("r.pos", "school", "r.city", "state", F.lit(True).alias("linked"))
    plain = rows.where("school is null and plain is not null").select("pos", F.col("plain").alias("school"), F.lit(None).cast("string").alias("city"), "state", F.lit(False).alias("linked"))
    return linked.union(plain).withColumn("division", S.normalize_division(F.lit(division)))


def line_table(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with the file each is from; a file of one article or list, so it is split in one task."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "value"))


@source("member_text")
def read_member_text(spark: SparkSession, path: str) -> DataFrame:
    return member_lines(line_table(spark, path))


@source("wiki_text")
def read_wiki(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Articles by division, united in the order given; one that isn't there is skipped with a warning."""
    found = []
    for d, p in paths.items():
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            found.append(wiki_members(line_table(spark, p), d, "file"))
        else:
            logging.getLogger(__name__).warning("no article at %s", p)
    if not found:
        raise FileNotFoundError(", ".join(paths.values()))
    return reduce(DataFrame.unionByName, found)


