"""Pages to rows: facts of a page, its links, and the staff rows of a directory page. Each page is parsed once, in one
pass over pieces of a batch; cheap gates come before it as ordinary filters, everything after it is DataFrame expressions."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache
from typing import NamedTuple
from urllib.parse import urljoin, urlparse

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rosterlake.functions import people as P
from rosterlake.functions import vocabulary as V
from rosterlake.functions import web as W
from rosterlake.functions.text import clean, let, lookup
from rosterlake.operators.dom import Node, parse, visible_text
from rosterlake.operators.merge import forward_fill
from rosterlake.operators.outline import Outline
from rosterlake.tables import materialise

_NOT_LINK = ("mailto:", "tel:", "javascript:", "#")
FACTS = (
    "site_name string, app_name string, ld_name string, title string, description string, ld_description string, ld_address string, address string, "
    "text string, next_url string, mailto array<string>, tel array<string>, links array<struct<pos:int,href:string,url:string,label:string>>"
)
_TEXTS = pa.list_(pa.string())
_LINK = pa.struct([("pos", pa.int32()), ("href", pa.string()), ("url", pa.string()), ("label", pa.string())])
#: The columns of FACTS and the error, as Arrow has them.
_FACTS = pa.schema(
    [(n, pa.string()) for n in "site_name app_name ld_name title description ld_description ld_address address text next_url".split()]
    + [("mailto", _TEXTS), ("tel", _TEXTS), ("links", pa.list_(_LINK)), ("error", pa.string())]
)
#: What is parsed before it is sent on: so many pages, and about so many bytes of them.
PIECE_PAGES, PIECE_BYTES = 64, 1 << 20


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces; a page that is longer than a piece is one of its own."""
    for rows in batches:
        size = pc.fill_null(pc.binary_length(rows.column("html")), 0).to_pylist()
        i = 0
        while i < len(size):
            j, held = i + 1, size[i]
            while j < min(len(size), i + PIECE_PAGES) and held + size[j] <= PIECE_BYTES:
                held += size[j]
                j += 1
            yield rows.slice(i, j - i)
            i = j


def _squeeze(s) -> str | None:
    return (re.sub(r"\s+", " ", s).strip() or None) if isinstance(s, str) else None


def _flat(data) -> list[dict]:
    """Objects of a JSON-LD value: itself, then those in its graph and item lists, at any depth."""
    if isinstance(data, list):
        return [x for item in data for x in _flat(item)]
    if not isinstance(data, dict):
        return []
    return [data, *_flat(data.get("@graph") or []), *_flat(data.get("itemListElement") or [])]


def linked_data(root: Node) -> list[dict]:
    out = []
    for n in root.find("script"):
        if n.get("type").lower() == "application/ld+json":
            try:
                out += _flat(json.loads(n.text()))
            except ValueError:
                continue
    return out


def _address(value) -> str | None:
    if isinstance(value, str):
        return _squeeze(value)
    if isinstance(value, dict):
        parts = [_squeeze(value.get(k)) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")]
        return ", ".join(p for p in parts if p) or None
    return None


def links_of(root: Node, base: str) -> list[dict]:
    out = []
    for n in root.find("a"):
        href = n.get("href")
        if href and not href.startswith(_NOT_LINK):
            try:
                out.append({"pos": len(out), "href": href, "url": urljoin(base, href), "label": n.text().strip()})
            except ValueError:
                continue
    return out


def page_facts(html: str, url: str, references: Sequence[str] | None = None, only: Sequence[str] | None = None, blank: str = r"\s+") -> dict:
    """The facts of a page by name; where only is given, no others are made."""
    root = parse(html, references=references)

    @cache
    def meta() -> dict[str, str]:
        out = {}
        for n in root.find("meta"):
            out.setdefault((n.get("property") or n.get("name")).lower(), n.get("content"))
        return out

    ld, links = cache(lambda: linked_data(root)), cache(lambda: links_of(root, url))
    kinds = lambda o: {str(t).lower() for t in (o.get("@type") if isinstance(o.get("@type"), list) else [o.get("@type")])}
    first = lambda xs: next((x for x in xs if x), None)
    long = lambda s: s if s and len(s) > 20 else None
    rel = lambda: (urljoin(url, n.get("href")) for n in root.find("a") if n.get("rel").lower() == "next" and n.get("href"))
    places = lambda: [re.sub(r"\s+", " ", " ".join(s for s, _ in n.strings())).strip() for n in root.walk() if n.tag == "address" or n.get("itemprop") == "address"][:1]
    made = {
        "site_name": lambda: _squeeze(meta().get("og:site_name")),
        "app_name": lambda: _squeeze(meta().get("application-name")),
        "ld_name": lambda: first(_squeeze(o.get("name")) for o in ld() if kinds(o) & {"organization", "localbusiness", "corporation"}),
        "title": lambda: first(_squeeze(n.text()) for n in root.find("title")),
        "description": lambda: first([long(_squeeze(meta().get("description"))), long(_squeeze(meta().get("og:description")))]),
        "ld_description": lambda: first(long(_squeeze(o.get("description"))) for o in ld()),
        "ld_address": lambda: first(_address(o.get("address")) for o in ld()),
        "address": lambda: first(p for p in places() if 10 < len(p) < 200),
        "text": lambda: visible_text(root, blank),
        "next_url": lambda: first([*rel(), *(x["url"] for x in links() if x["label"].lower() in V.NEXT_LABELS)]),
        "mailto": lambda: [n.get("href")[7:].split("?")[0].strip() for n in root.find("a") if n.get("href").startswith("mailto:")],
        "tel": lambda: [n.get("href")[4:].split("?")[0] for n in root.find("a") if n.get("href").startswith("tel:")],
        "links": links,
    }
    return {k: f() for k, f in made.items() if only is None or k in only}


def facts(pages: DataFrame, references: Sequence[str] | None = None, only: Sequence[str] | None = None, blank: str = r"\s+") -> DataFrame:
    """pages(page_id, url, html) with raw facts of each page beside url and html. A page that can't be parsed has null
    facts and its message in error. Where references are given, only these are read as characters; blank is what is
    squeezed in the visible text. Where only is given, these facts alone are made, and html comes back if it is named."""
    told = [f for f in _FACTS if only is None or f.name in {*only, "error"}]
    beside = ["page_id", "url"] + ["html"] * (only is None or "html" in only)

    def run(batches):
        for part in _pieces(batches):
            rows = []
            for html, url in zip(part.column("html").to_pylist(), part.column("url").to_pylist()):
                try:
                    rows.append({**page_facts(html or "", url or "", references, only, blank), "error": None})
                except Exception as e:  # one page's trouble isn't the others'
                    rows.append({"error": str(e)[:200]})
            made = [pa.array([r.get(f.name) for r in rows], f.type) for f in told]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in beside), *made], names=[*beside, *(f.name for f in told)])

    src = pages.select("page_id", "url", "html")
    kinds = src.select(beside).schema.fields + [f for f in StructType.fromDDL(f"{FACTS}, error string").fields if f.name in {t.name for t in told}]
    return src.mapInArrow(run, StructType(kinds))


def company_name(domain: Column) -> Column:
    """Over facts: site name, application name, JSON-LD name, the title's telling part, else the domain's words."""
    parts = F.filter(F.split("title", r"\s*[|–—\-·:]\s*"), lambda p: (p != "") & ~F.lower(F.trim(p)).isin(*V.GENERIC_TITLE_PARTS))
    two = F.slice(parts, 1, 2)
    longer = F.when(F.length(F.get(two, 1)) > F.length(F.get(two, 0)), F.get(two, 1)).otherwise(F.get(two, 0))
    title = F.when(F.size(parts) > 0, longer).otherwise(F.col("title"))
    word = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
    root = F.array_join(F.transform(F.split(F.substring_index(W.bare_host(domain), ".", 1), "-"), word), " ")
    return F.coalesce("site_name", "app_name", "ld_name", title, F.when(root != "", root))


def company_facts(pages: DataFrame) -> DataFrame:
    """One row a page: what a company record takes from it."""
    f = facts(pages).withColumn("domain", W.normalize_domain(F.col("url")))
    mail = F.filter(F.coalesce("mailto", F.array().cast("array<string>")), W.email_ok)
    every = F.array_distinct(F.concat(F.transform(mail, F.lower), W.emails_in(F.col("html"))))
    tel = F.filter(F.transform(F.coalesce("tel", F.array().cast("array<string>")), W.clean_phone), lambda x: x.isNotNull())
    street = F.regexp_extract("text", f"({V.AU_STREET})", 1)
    hay = F.concat_ws(" ", F.coalesce("description", F.lit("")), F.substring("text", 1, 6000))
    return f.select(
        "page_id", "url", "domain", company_name(F.col("domain")).alias("company_name"), F.substring(F.coalesce("description", "ld_description"), 1, 500).alias("description"),
        W.ranked_emails(every, F.col("domain")).alias("emails"), F.slice(F.array_distinct(F.concat(tel, W.phones_in(F.col("text")))), 1, 5).alias("phones"),
        F.coalesce(F.substring("ld_address", 1, 200), "address", F.when(street != "", F.trim(street))).alias("location"),
        W.industry_hints(hay).alias("industry_hints"), W.has_open_roles(F.col("text")).alias("open_roles"), F.length("text").alias("text_chars"), (F.length("text") < 600).alias("render_needed"),
        "next_url", "links", "error",
    )


def page_links(f: DataFrame) -> DataFrame:
    """facts -> a row a link: host, path and whether it stays on the site."""
    each = f.select("page_id", W.normalize_domain(F.col("url")).alias("domain"), F.explode("links").alias("l")).select("page_id", "domain", "l.pos", "l.href", "l.label", F.regexp_replace(F.substring_index("l.url", "#", 1), "/+$", "").alias("url"))
    host = F.regexp_replace(W.bare_host(W.netloc(F.col("url"))), ":.*$", "")
    root = F.regexp_replace(W.bare_host(F.col("domain")), ":.*$", "")
    each = each.withColumn("host", host).withColumn("path", F.lower(F.regexp_extract("url", r"^[^:/?#]*://[^/?#]*([^?#]*)", 1)))
    return each.withColumn("internal", F.col("url").rlike("^https?://") & ((F.col("host") == root) | F.endswith(F.col("host"), F.concat(F.lit("."), root))))


def _scored(links: DataFrame, hints: dict[str, int]) -> DataFrame:
    hay = F.concat_ws(" ", "path", F.lower(F.trim("label")))
    score = F.greatest(F.lit(0), *[F.when(F.contains(hay, F.lit(h)), w).otherwise(0) for h, w in hints.items()])
    return links.withColumn("score", score).where("score > 0").groupBy("page_id", "url").agg(F.max("score").alias("score"), F.min("pos").alias("pos"))


def internal_links(links: DataFrame) -> DataFrame:
    """Links of the site worth a visit, scored; order by score falling, then pos."""
    return _scored(links.where(F.col("internal") & ~F.col("path").rlike(V.BINARY_PATH)), V.PAGE_HINTS)


def directory_links(links: DataFrame, top: int = 5) -> DataFrame:
    from rosterlake.operators.lookups import top_k

    return top_k(_scored(links.where("internal"), V.DIRECTORY_HINTS), "page_id", [F.desc("score"), F.asc("pos")], top)


def outbound_domains(links: DataFrame) -> DataFrame:
    """Hosts that pages link to, other than themselves and services; each once, with the first place it was met."""
    out = links.where((F.col("host") != "") & (F.col("host") != F.regexp_replace(F.col("domain"), ":.*$", "")) & ~F.col("host").rlike(V.SKIP_HOSTS))
    return out.withColumn("out", W.normalize_domain(F.col("url"))).where("out is not null").groupBy(F.col("out").alias("domain")).agg(F.min(F.struct("page_id", "pos")).alias("at")).select("domain", "at.page_id", "at.pos")


def athletics_host(links: DataFrame) -> DataFrame:
    """The off-site host most linked under an athletics label; ties to the first met."""
    out = links.where(~F.col("internal") & (F.col("host") != "") & F.concat_ws(" ", "label", "href").rlike(V.ATHLETICS_LINK) & ~F.col("host").rlike(V.NOT_ATHLETICS_HOSTS))
    n = out.groupBy("page_id", "host").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return n.groupBy("page_id").agg(F.max_by("host", F.struct("n", -F.col("pos"))).alias("host"))


def socials(links: DataFrame) -> DataFrame:
    """First link of each platform on a page, without its query."""
    low = F.lower("url")
    named = F.array(*[F.when(F.exists(F.array(*[F.lit(h) for h in hosts]), lambda h: F.contains(low, h)), F.lit(p)) for p, hosts in V.SOCIAL_HOSTS.items()])
    each = links.select("page_id", "pos", F.substring_index("url", "?", 1).alias("bare"), F.explode(F.array_compact(named)).alias("platform")).withColumnRenamed("bare", "url")
    return each.groupBy("page_id", "platform").agg(F.min_by("url", "pos").alias("url"))


def fold_site(pages: DataFrame, spec) -> DataFrame:
    """company_facts rows of one site, in page order, as one company: ordered unions, first location and careers page,
    a sticky hiring flag, at most ten addresses and five numbers."""
    path = F.lower(F.regexp_extract("url", r"^[^:/?#]*://[^/?#]*([^?#]*)", 1))
    rows = pages.withColumn("careers", F.when(path.rlike(V.CAREERS_PATH), F.col("url")))
    from rosterlake.functions.text import union_lists
    from rosterlake.operators.merge import _ordered

    lists = lambda c, n: F.slice(union_lists(F.flatten(_ordered(c, "page_id"))), 1, n).alias(c)
    first = lambda c, name=None: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("page_id"))).alias(name or c)
    out = rows.groupBy("domain").agg(first("company_name"), first("url"), first("description"), lists("emails", 10), lists("phones", 5), first("location"), lists("industry_hints", 99), first("careers", "careers_url"), F.bool_or("open_roles").alias("open"), F.count("*").cast("int").alias("pages_crawled"))
    return out.withColumn("has_open_roles", F.when(F.col("open"), True).when(F.col("careers_url").isNotNull(), False)).drop("open")


# --- staff directories ---------------------------------------------------------------------------------------------

#: What any element that may stand for a person says about them.
WHO = "struct<scripted:array<string>,mailto:array<string>,tel:array<string>,profile_url:string,images:array<struct<src:string,alt:string>>>"
#: A part of a page that may hold people. Kind 0 is a table as it is written: its lines in order, each with the part of the table it stands in and its
#: cells. Kinds 1 (a card) and 2 (a block around one address) are a person each, in one line; marks are the kinds of card an element is, inside those of
#: the cards around it. Kind 9 is a page that could not be read. A line leaves Python as JSON, a tenth of its size as an object there.
PART = "kind:int,place:int,caption:string,above:string,raw_name:string,raw_title:string,marks:array<int>,inside:array<int>,error:string,lines:array<string>"
LINE = f"struct<part:string,th:array<string>,td:array<string>,linked:boolean,who:{WHO}>"
#: Characters of a line, at most: Spark's reader takes no JSON text of over twenty million.
_LONGEST = 19_000_000
_PROFILE = re.compile(V.PROFILE_PATH)
_SPLIT = re.compile(V.SPLIT_EMAIL)
_COACH = re.compile(V.COACH_TITLE)
_FIELDS = ("kind", "place", "caption", "above", "raw_name", "raw_title", "marks", "inside", "error", "lines")


def _profile(href: str) -> str | None:
    """A link to a person's own page, without its query."""
    return href.split("?")[0] if not href.startswith(_NOT_LINK) and _PROFILE.search(href) else None


def _part(kind: int, **said) -> dict:
    return {f: None for f in _FIELDS} | {"kind": kind} | said


def _contact(node: Node, base: str) -> dict:
    hrefs = [n.get("href") for n in node.find("a") if n.get("href")]
    plain = lambda scheme: [h[len(scheme) :].split("?")[0] for h in hrefs if h.startswith(scheme)]
    profile = next(filter(None, map(_profile, hrefs)), None)
    return {
        "scripted": [f"{a}@{b}" for s in node.find("script") for a, b in _SPLIT.findall(s.text())],
        "mailto": plain("mailto:"),
        "tel": plain("tel:"),
        "profile_url": profile and urljoin(base, profile),
        "images": [{"src": urljoin(base, n.get("data-src") or n.get("src")), "alt": n.get("alt")} for n in node.find("img") if n.get("data-src") or n.get("src")],
    }


def _line(part: str, th: list[str], td: list[str], node: Node, base: str) -> str:
    line = json.dumps({"part": part, "th": th, "td": td, "linked": any(n.get("href") for n in node.find("a")), "who": _contact(node, base)}, ensure_ascii=False, separators=(",", ":"))
    if len(line) > _LONGEST:
        raise ValueError("a row of the page is too long")
    return line


class Settled(NamedTuple):
    """A row of a table whose elements are gone: its line, its addresses and the people's pages it links to."""

    line: str
    mails: int
    profiles: tuple[str, ...]


def _row(tr: Node, base: str) -> str:
    part = next((a.tag for a in tr.ancestors() if a.tag in ("thead", "tbody", "tfoot", "table")), "")
    return _line(part, *([c.shown() for c in tr.find(tag)] for tag in ("th", "td")), tr, base)


def _fits(n: Node) -> bool:
    """Whether an element may be a block that stands for a person."""
    said = n.get("class")
    return n.tag in ("li", "article") or said != "" and any(w in said for w in ("staff", "person", "coach"))


def _heeded(n: Node) -> bool:
    """Whether an element is read otherwise than as part of a table's row: as a heading, a card or a block."""
    return n.tag in _SPEAKING or _fits(n) or bool(n.attrs) and (n.get("data-test-id") == V.CARD_NAME or bool(_marks(n)))


_SPEAKING = {"h1", "h2", "h3", "h4", "h5", "caption"}


def _settle(base: str):
    """A row that is read as a row only, as nothing in or around it is heeded, keeps its line and lets its elements go."""

    def settle(tr: Node) -> None:
        around = [*tr.ancestors()]
        if not any(a.tag == "table" for a in around) or any(a.tag in ("tr", "td", "th") or _heeded(a) for a in around):
            return
        if _heeded(tr) or any(n.tag in ("table", "tr") or _heeded(n) for n in tr.walk()):
            return
        hrefs = [n.get("href") for n in tr.find("a")]
        tr.settled = Settled(_row(tr, base), sum(h.startswith("mailto:") for h in hrefs), tuple({p for h in hrefs if h and (p := _profile(h))}))
        tr.children = []

    return settle


def _table(table: Node, over: str | None, base: str) -> dict:
    lines = [tr.settled.line if tr.settled else _row(tr, base) for tr in table.find("tr")]
    return _part(0, caption=next((c.shown() for c in table.find("caption")), None), above=over, lines=lines)


def _marks(node: Node) -> list[int]:
    """Which of the fixed marks of a person's card an element has."""
    return [i for i, (attribute, value) in enumerate(V.CARD_MARKS) if (node.get(attribute) == value if attribute == "data-test-id" else value in node.get(attribute))]


def _cards(root: Node, outline: Outline, base: str) -> list[dict]:
    """Every marked element; which marks count on a page, and which cards lie in others, is decided where the page's are together."""
    marked = {id(n): m for n in root.walk() if (m := _marks(n))}
    out = []
    for card in (n for n in root.walk() if id(n) in marked):
        says = {}
        for n in card.walk():
            texts = [t for s, _ in n.strings() if (t := s.strip())]
            if n.get("data-test-id") == V.CARD_NAME:
                says.setdefault("raw_name", "".join(texts))
            if V.CARD_TITLE in n.get("class"):
                says.setdefault("raw_title", " ".join(texts))
        inside = sorted({i for a in card.ancestors() for i in marked.get(id(a), ())})
        out.append(_part(1, above=outline.over(card), marks=marked[id(card)], inside=inside, lines=[_line("", [], [], card, base)], **says))
    return out


def _blocks(root: Node, outline: Outline, base: str) -> list[dict]:
    """From each address outwards: the widest list item, article or staff element that holds no other address."""
    mails = [n for n in root.find("a") if n.get("href").startswith("mailto:")]
    held = Counter(id(a) for n in mails for a in n.ancestors())
    out = []
    for mail in mails:
        block = next((a for a in reversed([*mail.ancestors()]) if a.parent is not None and _fits(a) and held[id(a)] == 1), None)
        if block is None:
            continue
        picks = [block.find(t) for t in ("h1", "h2", "h3", "h4", "h5")] + [[x for x in block.walk() if "name" in x.get("class")], block.find("a")]
        name = next((t for p in picks if p and 3 <= len(t := p[0].shown()) <= 60 and "@" not in t), None)
        if name:
            lines = [x.strip(" -–—·|") for x in re.split(r"\s{2,}|\|", block.shown().replace(name, " ", 1))]
            title = next((x for x in lines if _COACH.search(x) and len(x) <= 120), None)
            out.append(_part(2, raw_name=name, raw_title=title, above=outline.over(block), lines=[_line("", [], [], block, base)]))
    return out


def staff_parts(html: str, url: str) -> list[dict]:
    """A page's tables as written, its marked cards and its blocks with one address."""
    root = parse(html, _settle(url))
    outline = Outline(root, _profile)
    kinds = [_table(t, outline.over(t), url) for t in root.find("table")], _cards(root, outline, url), _blocks(root, outline, url)
    return [{**x, "place": i} for parts in kinds for i, x in enumerate(parts)]


def _usable(c: Column) -> Column:
    """Whether a caption or a lone heading names a group of people."""
    return (F.trim(c) != "") & (F.length(F.trim(c)) <= 80) & ~F.trim(c).rlike(V.GENERIC_HEADING)


def _grid(parts: DataFrame) -> DataFrame:
    """What the lines of each part mean: body, the place of each known column, the group its people belong to at first."""
    in_part = lambda p: F.filter("lines", lambda x: x["part"] == p)
    empty = F.array().cast("array<string>")
    head = F.filter(F.when(F.size(in_part("thead")) > 0, in_part("thead")).otherwise(F.col("lines")), lambda x: F.size(x["th"]) >= 2)
    body = F.when(F.size(in_part("tbody")) > 0, in_part("tbody")).otherwise(F.filter("lines", lambda x: x["part"] != "thead"))
    t = parts.withColumn("headers", F.coalesce(F.get(F.transform(head, lambda x: F.transform(x["th"], F.trim)), 0), empty)).withColumn("body", body)
    # the body is as wide as most of its lines; surplus headers, on the left, have no cells
    wide = F.filter(F.transform("body", lambda x: F.size(x["td"])), lambda n: n > 1)
    often = let(wide, lambda w: F.transform(F.array_distinct(w), lambda n: F.struct(F.size(F.filter(w, lambda k: k == n)).alias("times"), n.alias("width"))))
    width = let(often, lambda o: F.get(F.filter(o, lambda x: x["times"] == F.array_max(F.transform(o, lambda y: y["times"]))), 0)["width"])
    t = t.withColumn("surplus", F.greatest(F.lit(0), F.size("headers") - F.coalesce(width, F.size("headers"))))
    named = F.transform("headers", lambda h, i: F.struct(lookup(F.lower(h), V.COLUMN_ALIASES).alias("field"), (i - F.col("surplus")).alias("at"), h.alias("said")))
    t = t.withColumn("named", named).withColumn("columns", F.filter("named", lambda x: x["field"].isNotNull()))
    t = t.where((F.col("kind") > 0) | F.exists("columns", lambda x: x["field"] == "name"))
    first = lambda c: F.get(c, 0)
    spare = first(F.filter("named", lambda x: (x["at"] < 0) & x["field"].isNull() & (x["said"] != "")))["said"]
    lone = first(F.filter(F.transform(F.filter("lines", lambda x: (F.size(x["th"]) == 1) & (F.size(x["td"]) == 0)), lambda x: first(x["th"])), _usable))
    heading = F.when(F.coalesce("caption", F.lit("")) != "", F.when(_usable(F.col("caption")), F.col("caption"))).otherwise(lone)
    return t.select("page_id", "url", "kind", "place", "raw_name", "raw_title", "error", "columns", "body", F.coalesce(spare, heading, "above").alias("heading"))


def part_people(parts: DataFrame) -> DataFrame:
    """parts(page_id, url, PART) -> people as their lines say; in a table, a line of one cell names the group of those below it."""
    line = _grid(parts).select("page_id", "url", "kind", "place", "raw_name", "raw_title", "error", "columns", "heading", F.posexplode_outer("body").alias("line", "x"))
    cells = F.when(F.size("x.td") > 0, F.col("x.td")).otherwise(F.col("x.th"))
    alone = F.get(cells, 0)
    single = (F.col("kind") == 0) & (F.size(cells) == 1) & ~F.col("x.linked")
    line = line.withColumn("single", F.coalesce(single, F.lit(False))).withColumn("label", F.when(F.col("single") & (alone != "") & (F.length(alone) <= 80), alone))
    line = forward_fill(line, "label", ["page_id", "kind", "place"], "line").where("not single")

    def value(field: str) -> Column:
        places = F.filter("columns", lambda c: (c["field"] == field) & (c["at"] >= 0) & (c["at"] < F.size("x.td")))
        return F.get(F.col("x.td"), F.get(F.reverse(places), 0)["at"])

    own = F.col("kind") > 0
    name = F.when(own, F.col("raw_name")).otherwise(value("name"))
    out = line.select(
        "page_id", "url", "kind", "place", "line", "error", name.alias("raw_name"), F.when(own, F.col("raw_title")).otherwise(value("title")).alias("raw_title"), F.coalesce("label", "heading").alias("raw_group"),
        F.when(~own, value("email")).alias("cell_email"), F.when(~own, value("phone")).alias("cell_phone"), "x.who",
    )
    named = (F.coalesce("raw_name", F.lit("")) != "") & (own | ~F.col("raw_name").rlike(V.SKIP_NAME))
    return out.where(F.col("error").isNotNull() | named)


def raw_staff(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> raw people with pos: those of a page's tables, else of its cards, else of its blocks; each page is
    parsed once. A page that can't be parsed is one row that says so in `error`, and has no name."""

    def run(batches):
        for pdf in batches:
            for i, u, h in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                try:
                    found = staff_parts(h or "", u or "")
                except Exception as e:  # one page's trouble isn't the others'
                    found = [_part(9, place=0, lines=[], error=f"{type(e).__name__}: {e}"[:300])]
                yield pd.DataFrame({"page_id": [i], "url": [u], "parts": [found]})

    parts = pages.select("page_id", "url", "html").mapInPandas(run, f"page_id bigint, url string, parts array<struct<{PART}>>")
    # of the cards of a page those of its first mark count, and of those the outermost
    first = F.array_min(F.flatten(F.transform(F.filter("parts", lambda x: x["kind"] == 1), lambda x: x["marks"])))
    parts = parts.select("page_id", "url", first.alias("mark"), F.inline("parts"))
    parts = parts.withColumn("lines", F.transform("lines", lambda x: F.from_json(x, LINE, {"mode": "FAILFAST"})))
    parts = parts.where((F.col("kind") != 1) | (F.array_contains("marks", F.col("mark")) & ~F.array_contains("inside", F.col("mark"))))
    every = part_people(parts)
    best = Window.partitionBy("page_id")
    every = every.withColumn("_best", F.min("kind").over(best)).where("kind = _best")
    photo = F.filter("who.images", lambda m: ~F.startswith(m["src"], F.lit("data:")) & ~m["src"].rlike(V.STOCK_IMAGE) & ~F.coalesce(m["alt"], F.lit("")).rlike(V.STOCK_IMAGE))
    pos = (F.row_number().over(best.orderBy("place", "line")) - 1).alias("pos")
    return every.select("page_id", "url", pos, "raw_name", "raw_title", "raw_group", "who.scripted", "who.mailto", "who.tel", "cell_email", "cell_phone", "who.profile_url", F.when(F.col("kind") == 0, F.substring_index(F.get(photo, 0)["src"], "?", 1)).alias("photo_url"), "error")


def staff_rows(pages: DataFrame, spec, signals: int = 5) -> DataFrame:
    """pages(page_id, url, html) -> people of pages that pass the directory gate, folded by key within the page."""
    return staff_and_errors(pages, spec, signals)[0]


def staff_and_errors(pages: DataFrame, spec, signals: int = 5) -> tuple[DataFrame, DataFrame]:
    """staff_rows, and (page_id, url, error) of the gated pages that could not be read."""
    from rosterlake.operators.lookups import colleague_departments
    from rosterlake.operators.merge import dedupe_page, shared_emails

    gated = pages.where(W.looks_like_directory(F.col("html"), signals))
    # the steps below read their rows more than once; pages are parsed once
    kept = raw_staff(gated).where(F.col("error").isNotNull() | ~P.is_placeholder_name(F.col("raw_name")))
    kept = materialise(kept, "staff")
    raw, errors = kept.where("error is null"), kept.where("error is not null").select("page_id", "url", "error")
    group = P.clean_group(F.col("raw_group"))
    mails = F.filter(F.transform(F.concat("scripted", "mailto"), lambda x: F.lower(F.trim(x))), W.email_ok)
    phones = F.filter(F.transform(F.concat("tel", F.array(F.coalesce("cell_phone", F.lit("")))), W.clean_phone), lambda x: x.isNotNull())
    people = raw.withColumn("g", group).select(
        "page_id", "pos", P.normalize_person_name(F.col("raw_name")).alias("name"), W.normalize_domain(F.col("url")).alias("school_domain"), P.clean_title(clean(F.col("raw_title"))).alias("title"),
        F.when(P.is_sport(F.col("g.name")), F.col("g.name")).alias("sport"), F.when(~P.is_sport(F.col("g.name")), F.col("g.name")).alias("department"),
        F.array_distinct(F.concat(F.coalesce("g.emails", F.array().cast("array<string>")), mails, W.emails_in(F.col("cell_email")))).alias("emails"), W.add_phones(phones).alias("phones"),
        "profile_url", F.col("url").alias("source_url"), "photo_url", (F.size("g.emails") > 0).alias("shared_email"),
    ).withColumn("is_coach", P.is_coaching_title(F.col("title")))
    once = materialise(dedupe_page(people, spec), "staff")
    return shared_emails(colleague_departments(once, "page_id"), page="page_id"), errors


def athletics_share(people: DataFrame, least: float = 0.10) -> DataFrame:
    """Pages of which at least a tenth of the people have a sport."""
    return people.groupBy("page_id").agg(F.avg(F.when(F.coalesce("sport", F.lit("")) != "", 1.0).otherwise(0.0)).alias("share")).withColumn("athletics", F.col("share") >= least)


def from_titles(coaches: DataFrame) -> DataFrame:
    """Coaches of a general directory: no department, the sport that the title names, and a note where it does."""
    out = coaches.withColumn("department", F.lit(None).cast("string")).withColumn("sport", P.sport_from_title(F.col("title")))
    had = F.col("notes") if "notes" in coaches.columns else F.array().cast("array<string>")
    return out.withColumn("notes", F.when(F.col("sport").isNotNull(), F.array_union(had, F.array(F.lit(V.TITLE_NOTE)))).otherwise(had))


def coaches_only(people: DataFrame) -> DataFrame:
    """From each site's first page with a coach, its coaches, their sport read from the title."""
    coach = people.where("is_coach")
    first = coach.groupBy("school_domain").agg(F.min("page_id").alias("page_id"))
    return from_titles(coach.join(first, ["school_domain", "page_id"], "left_semi"))


def discovered(links: DataFrame) -> DataFrame:
    """Hosts that directories link to, as companies of which nothing but the host and where it was found is known."""
    return outbound_domains(links).select("domain", F.concat(F.lit("https://"), "domain").alias("url"), F.col("page_id").alias("found_on"))
