"""Queries: lookups, matching, filters, paging, facets, statistics, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rosterlake.functions import people as P
from rosterlake.functions import schools as S
from rosterlake.functions.text import lookup
from rosterlake.operators import lookups as L
from rosterlake.operators import queries as Q
from rosterlake.plans.adapters import adapter, cte
from rosterlake.plans.catalog import register
from rosterlake.plans.lifecycle import with_lists
from rosterlake.tables import shared_dir, table


def _people(spark, sf_dir):
    return with_lists(adapter(spark, sf_dir, "people"))


def _companies(spark, sf_dir):
    c = adapter(spark, sf_dir, "companies")
    pack = lambda *n: F.array_compact(F.array(*n))
    social = F.map_filter(F.create_map(F.lit("linkedin"), F.col("linkedin")), lambda k, v: v.isNotNull())
    return c.withColumn("emails", pack("email")).withColumn("phones", pack("phone")).withColumn("industry_hints", pack("hint1", "hint2")).withColumn("socials", social)


NORM = "trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower({}), '&', ' and '), '-', ' '), '\\b(the|of|at)\\b', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
HOSTS = """, hosts AS (SELECT key, 0 AS r, athletics_domain AS host, division, school FROM institutions UNION ALL SELECT key, 1, regexp_replace(regexp_extract(website, '^https?://([^/]*)', 1), '^www\\.', ''), division, school FROM institutions),
  divisions AS (SELECT host, arg_min(division, (key, r)) AS division FROM hosts WHERE host IS NOT NULL AND host <> '' AND division <> '' GROUP BY host)"""


@register("division_lookup_join", cte("people", "institutions") + HOSTS + " SELECT p.key, school_domain, d.division FROM people p LEFT JOIN divisions d ON school_domain = host")
def division_lookup_join(spark, sf_dir):
    return L.with_division(adapter(spark, sf_dir, "people"), adapter(spark, sf_dir, "institutions")).select("key", "school_domain", "division")


@register("division_filter", cte("people", "institutions") + HOSTS + " SELECT p.key, d.division FROM people p JOIN divisions d ON school_domain = host WHERE division IN ('DI', 'NAIA', 'DI; DII')")
def division_filter(spark, sf_dir):
    p = L.with_division(adapter(spark, sf_dir, "people"), adapter(spark, sf_dir, "institutions"))
    return p.where(Q.division_in(F.col("division"), "i,naia")).select("key", "division")


@register("official_name_fill", cte("people", "institutions") + HOSTS + ", names AS (SELECT host, arg_min(school, (key, r)) AS s FROM hosts WHERE host <> '' GROUP BY host) SELECT p.key, coalesce(n.s, p.school || ' College') AS school, coalesce(n.s, p.school || ' College') <> 'Official Home of ' || p.school || ' College Athletics' AS changed FROM people p LEFT JOIN names n ON school_domain = host")
def official_name_fill(spark, sf_dir):
    p = adapter(spark, sf_dir, "people").withColumn("school", F.concat(F.lit("Official Home of "), "school", F.lit(" College Athletics")))
    return L.official_names(p, adapter(spark, sf_dir, "institutions")).select("key", "school", F.col("school_changed").alias("changed"))


@register("host_maps", cte("institutions") + ", m AS (SELECT key, regexp_replace(regexp_extract(website, '^https?://([^/]*)', 1), '^www\\.', '') AS host, 'go-' || athletics_domain AS a FROM institutions WHERE website IS NOT NULL AND athletics_domain IS NOT NULL) SELECT host, arg_max(a, key) AS athletics_domain FROM m GROUP BY host")
def host_maps(spark, sf_dir):
    i = adapter(spark, sf_dir, "institutions").withColumn("athletics_domain", F.concat(F.lit("go-"), "athletics_domain"))
    return L.host_map(i)


STATE = "CASE lower({}) WHEN 'ca' THEN 'CA' WHEN 'california' THEN 'CA' WHEN 'tx' THEN 'TX' WHEN 'texas' THEN 'TX' WHEN 'ny' THEN 'NY' WHEN 'new york' THEN 'NY' WHEN 'on' THEN 'ON' WHEN 'ontario' THEN 'ON' END"
MATCHED = cte("sheet", "institutions") + f""", a AS (SELECT pos, school, {NORM.format('school')} AS n, {STATE.format('state')} AS s, regexp_replace(regexp_extract(link, '^https?://([^/]*)', 1), '^www\\.', '') AS host FROM sheet),
  b AS (SELECT key, {NORM.format('school')} AS n, {STATE.format('state')} AS s, athletics_domain AS own, regexp_replace(regexp_extract(website, '^https?://([^/]*)', 1), '^www\\.', '') AS site FROM institutions),
  j AS (SELECT a.pos, a.school, b.key, nullif(a.host, '') AS host, b.own, b.site FROM a LEFT JOIN b ON a.n = b.n AND a.s IS NOT DISTINCT FROM b.s),
  m AS (SELECT pos, school, key, host, own, CASE WHEN key IS NULL THEN 'unmatched' WHEN host IS NULL THEN 'no_link' WHEN own = host THEN 'already_known' WHEN own IS NOT NULL AND own <> coalesce(site, '') THEN 'conflicting' ELSE 'filled' END AS verdict FROM j)"""


@register("import_match_classify", MATCHED + " SELECT pos, school, key, host, verdict, verdict = 'filled' AND own IS NOT NULL AS replaced FROM m")
def import_match_classify(spark, sf_dir):
    return L.import_match(adapter(spark, sf_dir, "sheet"), adapter(spark, sf_dir, "institutions"))


@register("import_report", MATCHED + """ SELECT count(DISTINCT pos) AS rows, count(*) FILTER (WHERE verdict = 'filled') AS filled, count(*) FILTER (WHERE verdict = 'already_known') AS already_known, count(*) FILTER (WHERE verdict = 'conflicting') AS conflicting,
       count(*) FILTER (WHERE verdict = 'unmatched') AS unmatched, count(*) FILTER (WHERE verdict = 'no_link') AS no_link, count(*) FILTER (WHERE verdict = 'filled' AND own IS NOT NULL) AS replaced FROM m""")
def import_report(spark, sf_dir):
    return L.import_report(L.import_match(adapter(spark, sf_dir, "sheet"), adapter(spark, sf_dir, "institutions")))


def _fuzzy(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    t = p.select(F.col("p_partkey").alias("pos"), F.concat("p_name", F.lit(" University-Main Campus")).alias("name"), F.col("p_brand").alias("state"))
    return L.fuzzy_top1(t, p.select(F.col("p_partkey").alias("cid"), F.col("p_name").alias("name"), F.col("p_brand").alias("state")))


#: The ratio by its definition: the longest common run of a pair of segments (the earliest of equals), then what lies before and behind it, on and on.
RATIO = r"""WITH RECURSIVE keyed AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, lower(string_split(p_name, ' ')[1]) AS block, regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g') AS ck FROM part),
  goal AS (SELECT DISTINCT brand, block, ck || ' main' AS tk FROM keyed), offer AS (SELECT brand, block, ck, min(id) AS cid, arg_min(name, id) AS candidate FROM keyed GROUP BY ALL),
  words AS (SELECT DISTINCT tk, ck FROM goal JOIN offer USING (brand, block)),
  pair AS (SELECT row_number() OVER (ORDER BY tk, ck) AS p, tk, ck FROM words),
  a AS (SELECT p, unnest(generate_series(1, length(tk))) AS i, unnest(string_split(tk, '')) AS x FROM pair), b AS (SELECT p, unnest(generate_series(1, length(ck))) AS j, unnest(string_split(ck, '')) AS x FROM pair),
  eq AS (SELECT p, i, j FROM a JOIN b USING (p, x)),
  seg(p, al, ah, bl, bh, n) AS (SELECT p, 1, length(tk) + 1, 1, length(ck) + 1, 0 FROM pair
    UNION ALL SELECT s.p, unnest([s.al, i + n]), unnest([i, s.ah]), unnest([s.bl, j + n]), unnest([j, s.bh]), unnest([n, 0]) FROM (
      SELECT p, al, ah, bl, bh, arg_min(i, (-n, i, j)) AS i, arg_min(j, (-n, i, j)) AS j, max(n) AS n FROM (
        SELECT p, al, ah, bl, bh, min(i) AS i, min(j) AS j, count(*) AS n FROM (
          SELECT s.*, i, j, i - row_number() OVER (PARTITION BY s.p, al, bl, i - j ORDER BY i) AS run FROM (SELECT p, al, ah, bl, bh FROM seg WHERE ah > al AND bh > bl) s JOIN eq ON s.p = eq.p AND i >= al AND i < ah AND j >= bl AND j < bh)
        GROUP BY p, al, ah, bl, bh, i - j, run) GROUP BY p, al, ah, bl, bh) s),
  ratio AS (SELECT tk, ck, 2.0 * sum(n) / (length(tk) + length(ck)) AS score FROM seg JOIN pair USING (p) GROUP BY tk, ck)
  SELECT k.id AS pos, k.name || ' University-Main Campus' AS target, arg_max(o.cid, (score, -o.cid)) AS cid, arg_max(o.candidate, (score, -o.cid)) AS candidate, round(max(score), 6) AS score
  FROM keyed k JOIN offer o ON k.brand = o.brand AND k.block = o.block JOIN ratio r ON r.tk = k.ck || ' main' AND r.ck = o.ck WHERE score >= 0.6 GROUP BY k.id, k.name"""


@register("fuzzy_top1_match", RATIO)
def fuzzy_top1_match(spark, sf_dir):
    """Parts under perturbed names against all parts, within a brand."""
    return _fuzzy(spark, sf_dir).select("pos", "target", "cid", "candidate", F.round("score", 6).alias("score"))


@register("import_listings", MATCHED + """, c AS (SELECT 'conflicting' AS verdict, pos, school, own AS current, host AS offered FROM m WHERE verdict = 'conflicting' ORDER BY pos, school LIMIT 10),
       u AS (SELECT 'unmatched' AS verdict, pos, school, NULL AS current, NULL AS offered FROM m WHERE verdict = 'unmatched' ORDER BY pos LIMIT 5) SELECT * FROM c UNION ALL SELECT * FROM u""")
def import_listings(spark, sf_dir):
    i = adapter(spark, sf_dir, "institutions")
    return L.import_listings(L.import_match(adapter(spark, sf_dir, "sheet"), i), i)


@register("import_updates", MATCHED + " SELECT i.key, i.school, i.state, arg_min(m.host, (m.pos, m.host)) AS athletics_domain FROM m JOIN institutions i ON m.key = i.key WHERE verdict = 'filled' GROUP BY ALL")
def import_updates(spark, sf_dir):
    i = adapter(spark, sf_dir, "institutions")
    return L.update_records(L.import_match(adapter(spark, sf_dir, "sheet"), i), i)


@register(
    "enrichment_overlay",
    cte("sheet") + """, x AS (SELECT pos, pos % 3 <> 0 AS hit, pos % 5 AS k, CASE WHEN pos % 2 = 0 THEN 'NJCAA' ELSE 'NAIA' END AS association, link FROM sheet)
       SELECT pos, CASE WHEN hit AND k > 0 THEN 'City ' || k ELSE 'Home' END AS city, CASE WHEN hit THEN CASE WHEN k = 1 THEN 'Texas' WHEN k = 2 THEN 'Ontario' ELSE 'Utah' END ELSE 'Utah' END AS state,
       CASE WHEN NOT hit THEN 'old' WHEN k = 1 THEN 'South (West South Central)' WHEN k = 2 THEN 'Canada' END AS region, CASE WHEN hit AND k < 3 THEN 'www.match.example' ELSE link END AS website, association,
       CASE WHEN hit THEN '$' || k END AS cost, CASE WHEN hit AND k = 4 THEN 'SATMath=500-600' ELSE '' END AS scores, CASE WHEN hit THEN CASE k WHEN 1 THEN 'Public' WHEN 2 THEN 'Private (not-for-profit)' WHEN 3 THEN 'Private (for-profit)' ELSE 'Private (not-for-profit)' END END AS kind,
       CASE WHEN NOT hit THEN 'no College Scorecard match — academics and cost unfilled' WHEN k = 4 THEN '' WHEN association = 'NJCAA' THEN 'no admissions test scores — open-admission two-year college' ELSE 'no test scores published (test-optional reporting)' END AS notes FROM x""",
)
def enrichment_overlay(spark, sf_dir):
    """Sheet rows as members, two thirds of which have a match that fills some of its fields."""
    s = adapter(spark, sf_dir, "sheet").withColumn("k", F.col("pos") % 5)
    lit = F.lit
    members = s.select("pos", lit("Home").alias("city"), lit("Utah").alias("state"), lit("old").alias("region"), F.col("link").alias("website"), F.when(F.col("pos") % 2 == 0, "NJCAA").otherwise("NAIA").alias("association"), lit("Y").alias("private"))
    found = s.where("pos % 3 <> 0").select(
        "pos", F.when(F.col("k") > 0, F.concat(lit(" City "), F.col("k").cast("string"))).otherwise(" ").alias("city"), F.when(F.col("k") == 1, "TX").when(F.col("k") == 2, "ON").alias("state"),
        F.when(F.col("k") < 3, " www.match.example ").alias("website"), F.concat(lit("$"), F.col("k").cast("string")).alias("cost"), F.when(F.col("k") == 4, F.create_map(lit("SATMath"), lit("500-600"))).alias("scores"),
        F.when(F.col("k").between(1, 3), F.col("k")).alias("ownership"),
    )
    out = L.enrich(members, found)
    return out.select("pos", "city", "state", "region", "website", "association", F.col("totalYearlyCost").alias("cost"), Q.cell(F.col("academicData"), "map<string,string>").alias("scores"), F.col("privatePublic").alias("kind"), F.array_join("notes", "; ").alias("notes"))


@register(
    "source_url_backfill",
    cte("people", "site_outcomes") + f""", book AS (SELECT {NORM.format('school')} AS n, CASE WHEN count(DISTINCT url) = 1 THEN min(url) END AS book FROM (SELECT school, 'https://book.example/' || (id % 40) AS url FROM people WHERE id % 17 = 0) GROUP BY 1),
       runs AS (SELECT domain, arg_max(url, run_id) AS u FROM (SELECT 'germany.example' AS domain, run_id, min(url) AS url FROM site_outcomes WHERE people > 0 GROUP BY run_id) GROUP BY domain)
       SELECT p.key, coalesce(CASE WHEN p.sport = 'Basketball' THEN b.book END, r.u, b.book) AS source_url FROM people p LEFT JOIN book b ON {NORM.format('p.school')} = b.n LEFT JOIN runs r ON p.school_domain = r.domain""",
)
def source_url_backfill(spark, sf_dir):
    p = adapter(spark, sf_dir, "people").withColumn("sport", F.when(F.col("sport") == "Basketball", "Men's Basketball").otherwise(F.col("sport")))
    book = p.where("id % 17 = 0").select("school", F.concat(F.lit("https://book.example/"), (F.col("id") % 40).cast("string")).alias("url"))
    runs = adapter(spark, sf_dir, "site_outcomes").where("people > 0").groupBy("run_id").agg(F.min("url").alias("url"), F.max("people").alias("people")).withColumn("domain", F.lit("germany.example"))
    return L.source_urls(p, book, runs)


@register(
    "department_is_colleague",
    cte("people") + """, part AS (SELECT key, school_domain, unnest(string_split(department, ';')) AS t, unnest(generate_series(1, len(string_split(department, ';')))) AS i FROM people WHERE department IS NOT NULL),
       kept AS (SELECT key, i, trim(t) AS t FROM part a WHERE NOT EXISTS (SELECT 1 FROM people p WHERE p.school_domain = a.school_domain AND lower(p.name) = lower(trim(a.t)))), d AS (SELECT key, string_agg(t, '; ' ORDER BY i) AS department FROM kept GROUP BY key)
       SELECT p.key, d.department FROM people p LEFT JOIN d ON p.key = d.key""",
)
def department_is_colleague(spark, sf_dir):
    return L.colleague_departments(adapter(spark, sf_dir, "people")).select("key", "department")


@register("departments_all_unique", cte("people") + ", n AS (SELECT school_domain, department, count(*) AS n FROM people WHERE department <> '' AND department NOT LIKE '%Media%' GROUP BY ALL) SELECT school_domain, count(*) AS departments FROM n GROUP BY 1 HAVING count(*) >= 3 AND max(n) = 1")
def departments_all_unique(spark, sf_dir):
    return L.departments_all_unique(adapter(spark, sf_dir, "people").where("department NOT LIKE '%Media%'"))


@register("phantom_contacts", cte("people") + """, k AS (SELECT school_domain, unnest([email, email2]) AS e FROM people WHERE regexp_matches(name, '[A-Za-z]')), g AS (SELECT key, school_domain, list_filter([email, email2], lambda x: x IS NOT NULL) AS es FROM people WHERE NOT regexp_matches(name, '[A-Za-z]')),
       x AS (SELECT g.key, u.e, EXISTS (SELECT 1 FROM k WHERE k.school_domain = g.school_domain AND k.e = u.e) AS held FROM g, unnest(g.es) AS u(e)) SELECT g.key, len(g.es) > 0 AND coalesce((SELECT bool_and(held) FROM x WHERE x.key = g.key), FALSE) AS covered FROM g""")
def phantom_contacts(spark, sf_dir):
    return L.phantoms(_people(spark, sf_dir))


@register("placeholder_contacts", cte("people") + """, gone AS (SELECT * FROM people WHERE name IN ('TBA', '---')), other AS (SELECT school_domain, unnest([email, email2]) AS e FROM people WHERE name NOT IN ('TBA', '---')),
       sole AS (SELECT key, string_agg(DISTINCT e, '; ' ORDER BY e) AS sole_addresses FROM (SELECT key, school_domain, unnest(list_filter([email, email2], lambda x: x IS NOT NULL)) AS e FROM gone) g WHERE NOT EXISTS (SELECT 1 FROM other o WHERE o.school_domain = g.school_domain AND o.e = g.e) GROUP BY key)
       SELECT g.key, g.name, sole_addresses FROM gone g LEFT JOIN sole s ON g.key = s.key""")
def placeholder_contacts(spark, sf_dir):
    return L.placeholders(_people(spark, sf_dir))


@register("workbook_join", cte("sheet", "institutions") + f", b AS (SELECT {NORM.format('school')} AS n, lower(state) AS s, arg_min('h' || key, key) AS host FROM institutions GROUP BY ALL) SELECT pos, school, b.host FROM sheet s LEFT JOIN b ON {NORM.format('s.school')} = b.n AND lower(s.state) = b.s")
def workbook_join(spark, sf_dir):
    i = adapter(spark, sf_dir, "institutions").select("school", "state", F.concat(F.lit("h"), "key").alias("host"), F.col("key").alias("pos"))
    return L.workbook_matches(adapter(spark, sf_dir, "sheet").select("pos", "school", "state"), i).select("pos", "school", "host")


def _page(descending):
    def run(spark, sf_dir):
        out = Q.page(_people(spark, sf_dir).select("key", "sport", "emails", "name"), "emails", descending=descending, offset=40, limit=100)
        return out.select("key", F.coalesce(F.get("emails", 0), F.lit("")).alias("first_email"))

    return run


for _name, _desc, _word in (("blank_last_page_asc", False, "ASC"), ("blank_last_page_desc", True, "DESC")):
    register(_name, cte("people") + f", p AS (SELECT key, coalesce(email, email2) AS e FROM people) SELECT key, coalesce(e, '') AS first_email FROM p ORDER BY e IS NULL, lower(e) {_word}, key LIMIT 100 OFFSET 40")(_page(_desc))


_MAILED = cte("people") + ", p AS (SELECT key, coalesce(email, email2) AS e FROM people), o AS (SELECT key, e, row_number() OVER (ORDER BY e IS NULL, lower(e) DESC, key) - 1 AS i, count(*) OVER () AS n FROM p) "


@register("keyset_pages", _MAILED + "SELECT i // 40 AS page, key, coalesce(e, '') AS first_email FROM o WHERE i < 160")
def keyset_pages(spark, sf_dir):
    """Four pages in turn, each from the cursor of the one before."""
    p, parts, after = _people(spark, sf_dir), [], None
    for n in range(4):
        rows, cursor = Q.page_after(p, "emails", after, descending=True, limit=40)
        parts.append(rows.select(F.lit(n).alias("page"), "key", F.coalesce(F.get("emails", 0), F.lit("")).alias("first_email")))
        after = cursor()
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("deep_page", _MAILED + "SELECT key, coalesce(e, '') AS first_email FROM o WHERE i // 50 = n // 2 // 50")
def deep_page(spark, sf_dir):
    """The page in the middle of all people."""
    p = _people(spark, sf_dir)
    return Q.page_at(p, "emails", p.count() // 2 // 50, descending=True).select("key", F.coalesce(F.get("emails", 0), F.lit("")).alias("first_email"))


@register("sort_by_joined_division", cte("people", "institutions") + HOSTS + " SELECT p.key, d.division FROM people p LEFT JOIN divisions d ON school_domain = host ORDER BY division IS NULL, lower(division) DESC, p.key LIMIT 200")
def sort_by_joined_division(spark, sf_dir):
    p = L.with_division(adapter(spark, sf_dir, "people"), adapter(spark, sf_dir, "institutions"))
    return Q.page(p, "division", descending=True, limit=200).select("key", "division")


@register("filter_companies", cte("companies") + " SELECT key FROM companies WHERE email IS NOT NULL AND (hint1 LIKE '%retail%' OR hint2 LIKE '%retail%') AND has_open_roles")
def filter_companies(spark, sf_dir):
    return Q.filter_companies(_companies(spark, sf_dir), has_email=True, industry="Retail", hiring=True).select("key")


@register("filter_people", cte("people") + " SELECT key FROM people WHERE NOT departed AND (email IS NOT NULL OR email2 IS NOT NULL) AND is_coach AND phone IS NOT NULL")
def filter_people(spark, sf_dir):
    return Q.filter_people(_people(spark, sf_dir).withColumn("shared_email", F.lit(False)), has_phone=True, coaches_only=True, direct_email=True).select("key")


@register("departed_only", cte("people") + " SELECT key FROM people WHERE departed")
def departed_only(spark, sf_dir):
    return Q.filter_people(_people(spark, sf_dir), departed_only=True).select("key")


@register("record_search", "SELECT c_custkey FROM customer WHERE lower(concat_ws(chr(1), c_custkey, c_name, c_mktsegment)) LIKE '%build%' OR lower(c_name) LIKE '%build%'")
def record_search(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return c.where(Q.record_search(c, "Build")).select("c_custkey")


@register("indexed_search", "SELECT n AS needle, c_custkey FROM customer, (VALUES ('build'), ('#00000012'), ('r#'), ('mer#0'), ('77')) AS v(n) WHERE contains(lower(c_name), n) OR contains(lower(c_mktsegment), n) OR contains(c_custkey::VARCHAR, n)")
def indexed_search(spark, sf_dir):
    """Customers that have each of some needles, frequent, rare and short ones, by an index over all of them."""
    from functools import reduce

    from rosterlake.operators.search import SearchIndex

    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    index = SearchIndex.build(c, f"{shared_dir(spark)}/search-{uuid.uuid4().hex}", key="c_custkey", buckets=16)
    parts = [index.search(n).select(F.lit(n.lower()).alias("needle"), "c_custkey") for n in ("Build", "#00000012", "R#", "mer#0", "77")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("state_filter", cte("institutions") + f" SELECT key FROM institutions WHERE {STATE.format('state')} IN ('CA', 'NY') OR {STATE.format('state')} IS NULL")
def state_filter(spark, sf_dir):
    return adapter(spark, sf_dir, "institutions").where(Q.state_in(F.col("state"), ["California", "ny"], unknown_too=True)).select("key")


@register("name_filter", "SELECT c_custkey FROM customer WHERE lower(c_name) LIKE '%er#1%' OR lower(c_name) LIKE '%77%'")
def name_filter(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(Q.name_contains(F.col("c_name"), ["ER#1", "77"])).select("c_custkey")


@register("company_stats", cte("companies") + " SELECT count(*) AS companies, count(email) AS with_email, count(phone) AS with_phone, count(linkedin) AS with_linkedin, count(*) FILTER (WHERE has_open_roles) AS hiring FROM companies")
def company_stats(spark, sf_dir):
    return Q.company_stats(_companies(spark, sf_dir))


STATS = """ SELECT count(*) FILTER (WHERE {0}) AS people, count(*) FILTER (WHERE {0} AND (email IS NOT NULL OR email2 IS NOT NULL)) AS with_email, count(*) FILTER (WHERE {0} AND phone IS NOT NULL) AS with_phone, count(*) FILTER (WHERE {0} AND is_coach) AS coaches,
  count(*) FILTER (WHERE {0} AND (email IS NOT NULL OR email2 IS NOT NULL)) AS direct_email, count(*) FILTER (WHERE departed) AS departed, count(DISTINCT CASE WHEN {0} THEN school_domain END) AS schools FROM people"""


@register("people_stats", cte("people") + STATS.format("TRUE"))
def people_stats(spark, sf_dir):
    return Q.people_stats(_people(spark, sf_dir).withColumn("shared_email", F.lit(False)), with_departed=True)


@register("people_stats_in_post", cte("people") + STATS.format("NOT departed"))
def people_stats_in_post(spark, sf_dir):
    return Q.people_stats(_people(spark, sf_dir).withColumn("shared_email", F.lit(False)), with_departed=False)


@register("school_stats", cte("institutions") + """ SELECT count(*) AS schools, count(athletics_domain) AS with_athletics, count(website) AS with_website, count("totalYearlyCost") AS with_cost, count(conference) AS with_conference, count(nullif(division, '')) AS with_division FROM institutions""")
def school_stats(spark, sf_dir):
    return Q.school_stats(adapter(spark, sf_dir, "institutions"))


@register("completeness_report", cte("institutions") + """, n AS (SELECT 'website' AS field, count(website) AS filled, count(*) AS n FROM institutions UNION ALL SELECT 'division', count(nullif(division, '')), count(*) FROM institutions)
       SELECT field, filled, CAST(round_even(100.0 * filled / n, 0) AS INT) || '%' AS share FROM n""")
def completeness_report(spark, sf_dir):
    return Q.completeness(adapter(spark, sf_dir, "institutions"), ["website", "division"])


@register("industry_facet", cte("companies") + " SELECT h AS value, count(*) AS n FROM (SELECT unnest([hint1, hint2]) AS h FROM companies) WHERE h IS NOT NULL GROUP BY h")
def industry_facet(spark, sf_dir):
    return Q.facet(_companies(spark, sf_dir), F.col("industry_hints"))


@register("division_histogram", cte("institutions") + " SELECT division, count(*) AS n FROM institutions WHERE division <> '' GROUP BY division")
def division_histogram(spark, sf_dir):
    return Q.histogram(adapter(spark, sf_dir, "institutions"), "division")


@register("raw_sport_top", cte("people") + " SELECT sport, count(*) AS n FROM people WHERE sport <> '' GROUP BY sport ORDER BY n DESC, sport LIMIT 3")
def raw_sport_top(spark, sf_dir):
    return Q.top_counts(adapter(spark, sf_dir, "people").where("sport <> ''"), "sport", 3)


SPOKEN = {"AUTOMOBILE": "Head Men's Basketball Coach", "BUILDING": "WOMEN’S SOCCER", "FURNITURE": "Mens and Womens Swimming & Diving", "MACHINERY": "Crew; Track and Field", "HOUSEHOLD": "Facilities"}
SAID = """, said AS (SELECT c_custkey, unnest(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ['Men''s Basketball'] WHEN 'BUILDING' THEN ['Women''s Soccer'] WHEN 'FURNITURE' THEN ['Swimming & Diving'] WHEN 'MACHINERY' THEN ['Rowing', 'Track & Field'] ELSE [] END) AS label FROM customer)"""


def _spoken(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", lookup(F.col("c_mktsegment"), SPOKEN).alias("raw"))


@register("sport_labels", "WITH x AS (SELECT 1)" + SAID + ", l AS (SELECT c_custkey, string_agg(label, '; ' ORDER BY label) AS labels FROM said GROUP BY c_custkey) SELECT c.c_custkey, coalesce(labels, '') AS labels FROM customer c LEFT JOIN l ON c.c_custkey = l.c_custkey")
def sport_labels(spark, sf_dir):
    return _spoken(spark, sf_dir).select("c_custkey", F.array_join(P.sport_labels(F.col("raw")), "; ").alias("labels"))


@register("sport_facet", "WITH x AS (SELECT 1)" + SAID + ", n AS (SELECT label, count(*) AS n, regexp_replace(label, '^(Men''s|Women''s) ', '') AS base FROM said GROUP BY label) SELECT label, n, base, sum(n) OVER (PARTITION BY base) AS base_total, CASE WHEN label = base THEN 0 WHEN label LIKE 'Men''s%' THEN 1 ELSE 2 END AS variant, n < 50 AS rare FROM n")
def sport_facet(spark, sf_dir):
    s = _spoken(spark, sf_dir).withColumn("labels", P.sport_labels(F.col("raw")))
    return Q.sport_facet(s, F.col("labels"))


@register("sport_match_filter", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE' OR c_custkey % 50 = 0")
def sport_match_filter(spark, sf_dir):
    s = _spoken(spark, sf_dir).withColumn("labels", P.sport_labels(F.col("raw"))).withColumn("d", F.when(F.col("c_custkey") % 50 == 0, "Basketball Operations"))
    return s.where(P.sport_match(F.col("raw"), F.col("labels"), F.col("d"), "basketball")).select("c_custkey")


@register("csv_projection", cte("people") + """ SELECT key, name, concat_ws('; ', email, email2) AS emails, coalesce(sport, '') AS sport, CASE WHEN departed THEN 'True' ELSE 'False' END AS departed, coalesce(phone, '') AS phones FROM people""")
def csv_projection(spark, sf_dir):
    return Q.csv_cells(_people(spark, sf_dir), ["key", "name", "emails", "sport", "departed", "phones"])


@register("log_lines", cte("people") + " SELECT key, name AS label, title AS sublabel, coalesce(nullif(concat_ws(' | ', coalesce(email, email2), phone, nullif(sport, '')), ''), 'no contact details') AS summary FROM people")
def log_lines(spark, sf_dir):
    return Q.log_lines(_people(spark, sf_dir), "person")


@register("origin_export", cte("institutions") + """ SELECT school, state, division, conference, "totalYearlyCost", CASE WHEN "totalYearlyCost" IS NOT NULL THEN 'SATMath=' || "totalYearlyCost" ELSE '' END AS "academicData" FROM institutions""")
def origin_export(spark, sf_dir):
    i = adapter(spark, sf_dir, "institutions").withColumn("academicData", F.create_map(F.lit("other"), F.lit("x"), F.lit("SATMath"), F.col("totalYearlyCost")))
    return Q.origin_shape(i).withColumn("academicData", Q.cell(F.col("academicData"), "map<string,string>"))


@register("seed_list", cte("institutions") + " SELECT key, coalesce(athletics_domain, nullif(regexp_replace(regexp_extract(website, '^https?://([^/]*)', 1), '^www\\.', ''), '')) AS host, CASE WHEN athletics_domain IS NOT NULL THEN 'athletics' WHEN website IS NOT NULL THEN 'fallback' ELSE 'missing' END AS origin FROM institutions")
def seed_list(spark, sf_dir):
    return Q.seed_hosts(adapter(spark, sf_dir, "institutions"))


@register("outcome_lines", cte("site_outcomes") + " SELECT domain || '  # ' || status || CASE WHEN detail <> '' THEN ': ' || detail ELSE '' END AS line FROM site_outcomes")
def outcome_lines(spark, sf_dir):
    return Q.seed_lines(adapter(spark, sf_dir, "site_outcomes"))


@register("ordered_distinct", cte("site_outcomes") + " SELECT domain, min(pos) AS pos FROM site_outcomes GROUP BY domain")
def ordered_distinct(spark, sf_dir):
    return Q.ordered_distinct(adapter(spark, sf_dir, "site_outcomes"), "domain", "pos")


@register("batch_seeds", "SELECT page_id, (row_number() OVER (ORDER BY page_id) - 1) // 40 AS batch FROM pages")
def batch_seeds(spark, sf_dir):
    return Q.batches(table(spark, sf_dir, "pages").select("page_id"), "page_id", 40)


@register("union_of_sources", "SELECT domain, min(CASE WHEN src = 'p' THEN page_id END) AS pos FROM (SELECT 'p' AS src, page_id, regexp_replace(regexp_extract(lower(url), '^https?://([^/?#]*)', 1), '^www\\.', '') AS domain FROM pages UNION ALL SELECT 's', NULL, 'only.example') GROUP BY domain")
def union_of_sources(spark, sf_dir):
    """Seeds given directly and seeds of a list, united: each host once."""
    from rosterlake.sources import files

    listed = files.domains_of(table(spark, sf_dir, "pages"), F.col("url"), F.col("page_id"))
    given = files.read_seeds(spark, first=["https://www.only.example/x"]).select("domain", F.lit(None).cast("long").alias("pos"))
    return listed.unionByName(given).groupBy("domain").agg(F.min("pos").alias("pos"))


@register("set_difference", cte("people", "rosters") + " SELECT p.key FROM people p WHERE NOT departed AND EXISTS (SELECT 1 FROM rosters r WHERE r.domain = p.school_domain) AND NOT EXISTS (SELECT 1 FROM rosters r WHERE r.domain = p.school_domain AND r.key = p.key)")
def set_difference(spark, sf_dir):
    """Live people whom the roster of their own school doesn't list."""
    from rosterlake.operators import reconcile as R

    return R.missing(adapter(spark, sf_dir, "people"), adapter(spark, sf_dir, "rosters")).select("key")


@register("taxonomy_report", "WITH x AS (SELECT 1)" + SAID + ", n AS (SELECT label, count(*) AS n, regexp_replace(label, '^(Men''s|Women''s) ', '') AS base FROM said GROUP BY label) SELECT base, label, sum(n) AS n FROM n GROUP BY ROLLUP (base, label) HAVING base IS NOT NULL")
def taxonomy_report(spark, sf_dir):
    s = _spoken(spark, sf_dir).select(F.explode(P.sport_labels(F.col("raw"))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return s.withColumn("base", P.sport_base(F.col("label"))).rollup("base", "label").agg(F.sum("n").alias("n")).where("base is not null")


@register("taxonomy_rare", "WITH x AS (SELECT 1)" + SAID + ", n AS (SELECT label, count(*) AS n, regexp_replace(label, '^(Men''s|Women''s) ', '') AS base FROM said GROUP BY label) SELECT base, label, n, n < 50 AS rare, sum(n) OVER (PARTITION BY base) AS base_total FROM n")
def taxonomy_rare(spark, sf_dir):
    """Labels with their group's total, and whether fewer than 50 rows have them."""
    return Q.sport_facet(_spoken(spark, sf_dir), P.sport_labels(F.col("raw"))).select("base", "label", "n", "rare", "base_total")
