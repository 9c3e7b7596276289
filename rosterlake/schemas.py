"""Entities: their columns, keys and merge rules, declared once."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.functions import people, schools

_S, _L, _M = T.StringType(), T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.StringType())


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


COMPANY = _struct(
    domain=_S, company_name=_S, url=_S, description=_S, emails=_L, phones=_L, location=_S, socials=_M, industry_hints=_L, careers_url=_S,
    has_open_roles=T.BooleanType(), pages_crawled=T.IntegerType(), source=_S, first_seen=_S, last_seen=_S, notes=_L,
)
PERSON = _struct(
    name=_S, school=_S, school_domain=_S, title=_S, sport=_S, department=_S, emails=_L, phones=_L, profile_url=_S, source_url=_S, photo_url=_S, photo_file=_S,
    is_coach=T.BooleanType(), shared_email=T.BooleanType(), source=_S, first_seen=_S, last_seen=_S, departed=T.BooleanType(), departed_at=_S, notes=_L,
)
INSTITUTION = _struct(
    school=_S, city=_S, state=_S, country=_S, division=_S, conference=_S, region=_S, totalYearlyCost=_S, academicData=_M, privatePublic=_S, athletics_domain=_S,
    website=_S, ncaa_org_id=T.IntegerType(), association=_S, source=_S, first_seen=_S, last_seen=_S, notes=_L,
)
OUTCOME = _struct(domain=_S, status=_S, detail=_S, people=T.IntegerType(), url=_S, school=_S)


@dataclass(frozen=True)
class EntitySpec:
    """How rows of one key become one: each column is named under one rule."""

    name: str
    key: Column | str
    newest: tuple[str, ...] = ()  # newest non-empty
    newest_known: tuple[str, ...] = ()  # newest non-null
    join_unique: tuple[str, ...] = ()  # packed strings, parts once
    union: tuple[str, ...] = ()  # lists, values once
    overlay: tuple[str, ...] = ()  # maps, newest value per map key
    overlay_filled: tuple[str, ...] = ()  # the same, empty incoming values ignored
    any_: tuple[str, ...] = ()
    least: tuple[str, ...] = ()
    greatest: tuple[str, ...] = ()
    reset: dict = field(default_factory=dict)  # values after any merge
    required: tuple[str, ...] = ()
    schema: T.StructType | None = None


def company() -> EntitySpec:
    return EntitySpec(
        "company", F.lower("domain"), newest=("domain", "company_name", "url", "description", "location", "careers_url", "source"), newest_known=("has_open_roles",),
        union=("emails", "phones", "industry_hints", "notes"), overlay=("socials",), greatest=("pages_crawled", "last_seen"), least=("first_seen",), required=("domain",), schema=COMPANY,
    )


def person() -> EntitySpec:
    return EntitySpec(
        "person", people.person_key(F.col("profile_url"), F.col("school_domain"), F.col("name")),
        newest=("name", "school", "school_domain", "title", "profile_url", "source_url", "photo_url", "photo_file", "source"), join_unique=("sport", "department"), union=("emails", "phones", "notes"),
        any_=("is_coach", "shared_email"), least=("first_seen",), greatest=("last_seen",), reset={"departed": F.lit(False), "departed_at": F.lit(None).cast("string")}, required=("name", "school_domain"), schema=PERSON,
    )


def institution() -> EntitySpec:
    c = F.col
    return EntitySpec(
        "institution", schools.school_key(c("ncaa_org_id"), c("school"), c("state"), c("country"), c("association")),
        newest=("school", "city", "state", "country", "conference", "region", "totalYearlyCost", "privatePublic", "athletics_domain", "website", "ncaa_org_id", "association", "source"),
        join_unique=("division",), union=("notes",), overlay_filled=("academicData",), least=("first_seen",), greatest=("last_seen",), required=("school",), schema=INSTITUTION,
    )
