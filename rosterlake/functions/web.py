"""Hosts, addresses and phone numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlake.functions import vocabulary as V
from rosterlake.functions.text import let, squeeze, strip, strip_edge


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1)


def bare_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def normalize_domain(value: Column) -> Column:
    """Host of a URL or bare name: lower case, no www., no default port; null if it isn't one."""
    v = F.lower(strip_edge(strip(value), "\"'"))
    v = F.when(F.contains(v, F.lit("://")), v).otherwise(F.concat(F.lit("https://"), v))

    def parts(n: Column) -> Column:
        host = F.regexp_replace(F.regexp_extract(n, r"^([^:]*)", 1), r"^www\.", "")
        port = F.regexp_extract(n, r"^[^:]*:(.*)$", 1)
        good = (host != "") & ~F.contains(host, F.lit(" ")) & (F.contains(host, F.lit(".")) | (host == "localhost"))
        return F.when(good, F.when((port != "") & ~port.isin("80", "443"), F.concat_ws(":", host, port)).otherwise(host))

    return F.when(strip(value) != "", let(F.regexp_replace(netloc(v), r"^.*@", ""), parts))


def email_ok(c: Column) -> Column:
    return F.coalesce(c.rlike(f"^(?:{V.EMAIL})$") & ~c.rlike(V.EMAIL_NOISE), F.lit(False))


def emails_in(text: Column) -> Column:
    """Good addresses of a text, lower-cased, each once, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({V.EMAIL})"), F.lit(1))
    return F.array_distinct(F.transform(F.filter(found, email_ok), F.lower))


def ranked_emails(found: Column, domain: Column, top: int = 10) -> Column:
    """Addresses on the site's own domain first, generic ones first among equals, else as found; at most `top`."""
    root = bare_host(domain)

    def rank(x: Column, i: Column) -> Column:
        at = F.locate("@", x)
        own = F.when(F.endswith(F.substr(x, at + 1), root), 0).otherwise(1)
        generic = F.when(F.substring_index(x, "@", 1).isin(*V.GENERIC_LOCAL_PARTS), 0).otherwise(1)
        return F.struct(own.alias("a"), generic.alias("b"), i.alias("i"), x.alias("x"))

    return F.slice(F.transform(F.array_sort(F.transform(found, rank)), lambda s: s["x"]), 1, top)


def format_phone(candidate: Column) -> Column:
    """North American numbers as +1 AAA EEE NNNN, with an extension as xN; others unchanged."""

    def shape(d: Column) -> Column:
        n = F.length(d)
        grouped = candidate.rlike(r"\d\D+\d")
        base = (
            F.when(n == 10, d)
            .when((n == 11) & F.startswith(d, F.lit("1")), F.substring(d, 2, 10))
            .when((n > 11) & F.startswith(d, F.lit("1")), F.substring(d, 2, 10))
            .when((n > 10) & grouped, F.substring(d, 1, 10))
        )
        ext = F.when((n > 11) & F.startswith(d, F.lit("1")), F.substr(d, F.lit(12))).when((n > 10) & ~F.startswith(d, F.lit("1")) & grouped, F.substr(d, F.lit(11))).otherwise(F.lit(""))
        foreign = F.startswith(F.ltrim(candidate), F.lit("+")) & ~F.startswith(d, F.lit("1"))
        keep = foreign | base.isNull() | (F.length(ext) > 6) | F.substring(base, 1, 1).isin("0", "1") | F.substring(base, 4, 1).isin("0", "1")
        shaped = F.concat(F.lit("+1 "), F.substring(base, 1, 3), F.lit(" "), F.substring(base, 4, 3), F.lit(" "), F.substring(base, 7, 4))
        return F.when(keep, candidate).otherwise(F.concat(shaped, F.when(ext != "", F.concat(F.lit(" x"), ext)).otherwise(F.lit(""))))

    return let(F.regexp_replace(candidate, r"\D", ""), shape)


def clean_phone(raw: Column) -> Column:
    """A phone-like text normalised, or null where it is only digits."""

    def judge(c: Column) -> Column:
        d = F.regexp_replace(c, r"\D", "")
        ok = F.length(d).between(8, 15) & (F.size(F.array_distinct(F.split(d, ""))) > 2) & (~c.rlike(r"\d{12,}") | F.startswith(c, F.lit("+")))
        return F.when(ok, format_phone(c))

    return let(squeeze(F.regexp_replace(raw, r"[^\d+]", " ")), judge)


def add_phones(found: Column) -> Column:
    """Numbers in order, without those whose digits end another's, the shorter having seven or more; first wins."""
    digits = lambda p: F.regexp_replace(p, r"\D", "")

    def same(a: Column, b: Column) -> Column:
        shorter = F.least(F.length(a), F.length(b))
        return (a == b) | ((shorter >= 7) & (F.endswith(a, b) | F.endswith(b, a)))

    start = F.array().cast("array<string>")
    return F.aggregate(found, start, lambda acc, p: F.when(p.isNull() | F.exists(acc, lambda q: same(digits(q), digits(p))), acc).otherwise(F.concat(acc, F.array(p))))


def phones_in(text: Column, top: int = 5) -> Column:
    """Numbers that a phone word introduces, at most six characters before, within forty after it."""
    text = F.coalesce(text, F.lit(""))
    # a look-ahead keeps the window unread, so one label's window may hold the next label
    window = F.regexp_extract_all(text, F.lit(f"{V.PHONE_CONTEXT}(?=([\\s\\S]{{0,40}}))"), F.lit(1))
    near = F.transform(window, lambda w: F.regexp_extract(w, f"^(?=[\\s\\S]{{0,6}}?({V.PHONE}))", 1))
    return F.slice(F.array_distinct(F.filter(F.transform(F.filter(near, lambda x: x != ""), clean_phone), lambda x: x.isNotNull())), 1, top)


def industry_hints(haystack: Column, top: int = 5) -> Column:
    from rosterlake.functions.text import contains_any

    hints = lambda low: F.array(*[F.when(contains_any(low, words), F.lit(name)) for name, words in V.INDUSTRIES.items()])
    return F.slice(F.array_compact(let(F.lower(haystack), hints)), 1, top)


def has_open_roles(text: Column) -> Column:
    from rosterlake.functions.text import contains_any

    return let(F.lower(text), lambda low: contains_any(low, V.OPEN_ROLE_MARKERS))


def looks_like_directory(html: Column, signals: int = 5) -> Column:
    """A cheap test before any parsing: enough mail links, table rows under a staff title, cards or profile links."""

    def judge(low: Column) -> Column:
        count = lambda needle: F.regexp_count(low, F.lit(needle))
        links = F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(f"({V.PROFILE_LINK})"), F.lit(1))))
        return (count("mailto:") >= signals) | (F.contains(low, F.lit("staff directory")) & (count("<tr") >= signals)) | (count("s-person-card") >= signals) | (links >= signals)

    return let(F.lower(F.coalesce(html, F.lit(""))), judge)


def sport_slugs(html: Column, top: int = 40) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(html, F.lit(""))), F.lit(V.SPORT_SLUG), F.lit(1))
    return F.slice(F.array_sort(F.array_distinct(found)), 1, top)


def status_class(status: Column, body: Column | None = None) -> Column:
    ok = status.between(200, 299) & ((F.coalesce(body, F.lit("")) != "") if body is not None else F.lit(True))
    return F.when(ok, "ok").when(status.isin(*V.BLOCKED_STATUSES), "blocked").when(status == V.ROBOTS_STATUS, "robots").when(status == V.NETWORK_STATUS, "network").otherwise("other")


def retry_class(status: Column, error: Column) -> Column:
    """Whether a fetch is worth another attempt: permanent name errors never, 429 and 5xx always."""
    from rosterlake.functions.text import contains_any

    permanent = contains_any(F.lower(F.coalesce(error, F.lit(""))), V.PERMANENT_ERRORS)
    return F.when(permanent, "permanent").when((status == 429) | status.between(500, 599) | (status == 0), "retry").otherwise("final")
