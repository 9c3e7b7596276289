from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterlake import repairs, schemas
from rosterlake.functions import vocabulary as V
from rosterlake.operators import html as H
from rosterlake.operators import lookups as L
from rosterlake.operators import merge as M
from rosterlake.operators import queries as Q
from rosterlake.operators import reconcile as R
from rosterlake.operators.dom import parse, visible_text


def people(spark, rows):
    cols = [f.name for f in schemas.PERSON]
    full = [tuple({"name": "x", "school_domain": "a.edu", **r}.get(c) for c in cols) for r in rows]
    df = spark.createDataFrame(full, schemas.PERSON)
    return df.withColumn("key", schemas.person().key)


def test_merge_rules(spark):
    rows = people(spark, [
        {"name": "Ann Doe", "title": "Coach", "sport": "Golf", "emails": ["a@x.org"], "departed": True, "departed_at": "2024", "first_seen": "1", "last_seen": "1", "is_coach": False},
        {"name": "Ann Doe", "title": "", "sport": "Tennis; Golf", "emails": ["b@x.org", "a@x.org", ""], "departed": False, "first_seen": "2", "last_seen": "2", "is_coach": True},
        {"name": "Bo", "sport": "a;a", "emails": ["c", "c"], "departed": True, "departed_at": "2023"},
    ]).withColumn("seq", F.monotonically_increasing_id())
    out = {r["name"]: r for r in M.merge(rows.coalesce(1).withColumn("seq", F.monotonically_increasing_id()), schemas.person()).collect()}
    ann, bo = out["Ann Doe"], out["Bo"]
    assert (ann["title"], ann["sport"], ann["emails"], ann["departed"], ann["departed_at"], ann["is_coach"], ann["first_seen"], ann["last_seen"]) == ("Coach", "Golf; Tennis", ["a@x.org", "b@x.org"], False, None, True, "1", "2")
    assert (bo["sport"], bo["emails"], bo["departed"], bo["departed_at"]) == ("a;a", ["c", "c"], True, "2023")  # seen once: untouched


def test_map_overlays(spark):
    rows = spark.createDataFrame([("k", 1, {"a": "1", "b": "2"}), ("k", 2, {"b": "", "c": "3"}), ("k", 3, None)], "key string, seq int, m map<string,string>")
    one = M.merge(rows, schemas.EntitySpec("x", "key", overlay=("m",))).first()["m"]
    two = M.merge(rows, schemas.EntitySpec("x", "key", overlay_filled=("m",))).first()["m"]
    assert one == {"a": "1", "b": "", "c": "3"} and two == {"a": "1", "b": "2", "c": "3"}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["", "a", "b", None])), min_size=1, max_size=12))
def test_merge_is_a_fold(spark, rows):
    df = spark.createDataFrame([(str(k), i, v, [v or ""]) for i, (k, v) in enumerate(rows)], "key string, seq int, v string, tags array<string>")
    got = {r["key"]: (r["v"], r["tags"]) for r in M.merge(df, schemas.EntitySpec("x", "key", newest=("v",), union=("tags",))).collect()}
    want: dict = {}
    for k, v in rows:
        if str(k) not in want:
            want[str(k)] = (v, [v or ""], 1)
        else:
            old, tags, n = want[str(k)]
            want[str(k)] = (v or old, list(dict.fromkeys(t for t in [*tags, v or ""] if t)), n + 1)
    assert got == {k: (v, t) for k, (v, t, _) in want.items()}


def test_rekey_folds_collisions(spark):
    rows = people(spark, [{"name": "Ann Doe '19", "emails": ["a@x.org"]}, {"name": "Ann Doe", "emails": ["b@x.org"]}])
    out = repairs.names(rows, schemas.person()).collect()
    assert len(out) == 1 and sorted(out[0]["emails"]) == ["a@x.org", "b@x.org"] and out[0]["name"] == "Ann Doe"


def test_reconcile_guard(spark):
    rows = people(spark, [{"name": f"p{i}", "school_domain": "big.edu"} for i in range(6)] + [{"name": f"q{i}", "school_domain": "small.edu"} for i in range(3)] + [{"name": "z", "school_domain": "unmet.edu"}, {"name": "g", "school_domain": "small.edu", "departed": True, "departed_at": "2020"}])
    keep = lambda pred: rows.where(pred).select(F.col("school_domain").alias("domain"), "key")
    out = {r["name"]: (r["departed"], r["departed_at"]) for r in R.reconcile(rows, keep("name in ('p0','p1','q0')"), "now").collect()}
    assert all(out[f"p{i}"] == (False, None) for i in range(6))  # 4 of 6 would go: skipped
    assert out["q0"] == (False, None) and out["q1"] == out["q2"] == (True, "now") and out["z"] == (False, None) and out["g"] == (True, "2020")
    report = {r["domain"]: r for r in R.reconcile_report(rows, keep("name in ('p0','p1','q0')")).collect()}
    assert report["big.edu"]["skipped"] and report["small.edu"]["departed"] == 2 and "unmet.edu" not in report
    half = {r["name"]: r["departed"] for r in R.reconcile(rows, keep("name in ('p0','p1','p2')"), "now").collect()}
    assert half["p5"]  # exactly half isn't over half


def test_outcomes(spark):
    rows = [("a", 1, "u1", 200, "x", ""), ("a", 2, "u2", 429, "", ""), ("a", 3, "u3", 403, "", ""), ("b", 1, "u", 999, "", ""), ("c", 1, "u", 0, "", ""), ("c", 2, "u", 0, "", "dns"), ("d", 1, "u", 404, "", ""), ("e", 1, "u", 200, "x", ""), ("f", 1, "u", 200, "", "")]
    sites = spark.createDataFrame([(d,) for d in "abcdefg"], "domain string")
    out = {r["domain"]: (r["status"], r["detail"], r["url"]) for r in R.classify_outcomes(sites, spark.createDataFrame(rows, "domain string, seq int, url string, status int, body string, error string")).collect()}
    assert out["a"] == ("blocked", "server refused automated requests (HTTP 403, 429)", "u2") and out["b"][0] == "robots" and out["c"] == ("network", "dns", "u")
    assert out["d"] == ("network", "no page fetched successfully (HTTP 404)", "u") and out["e"][0] == "no_directory" and out["f"][0] == "network" and out["g"] == ("network", "no requests completed", None)


def test_backoff(spark):
    rows = [("h", i, s) for i, s in enumerate([429, 503, 200, 404, 200, 200, 200, 200, 200])] + [("k", i, 429) for i in range(9)]
    out = {r["host"]: r["penalty"] for r in R.backoff_state(spark.createDataFrame(rows, "host string, seq int, status int")).collect()}
    assert out == {"h": 1.0, "k": 16.0}


def test_pages_blank_last(spark):
    rows = spark.createDataFrame([("a", "b", 3.0), ("b", "", -1.0), ("c", None, None), ("d", "A", 0.0), ("e", "b", 2.0)], "key string, s string, n double")
    order = lambda c, d: [r["key"] for r in Q.page(rows, c, descending=d).collect()]
    assert order("s", False) == ["d", "a", "e", "b", "c"] and order("s", True) == ["a", "e", "d", "b", "c"]
    assert order("n", False) == ["b", "d", "e", "a", "c"] and [r["key"] for r in Q.page(rows, "s", offset=1, limit=2).collect()] == ["a", "e"]
    with pytest.raises(ValueError):
        Q.page(rows, "nope")
    assert Q.page_count(0, 50) == 1 and Q.page_count(101, 50) == 3
    assert "TakeOrderedAndProject" in Q.page(rows, "s")._jdf.queryExecution().executedPlan().toString()


def test_null_safe_import(spark):
    rows = spark.createDataFrame([(1, "The Red College", None, "https://red.org/x"), (2, "Blue College", "TX", "https://new.org"), (3, "None", "TX", "https://x.org"), (4, "Green College", "TX", "https://www.green.edu/t")], "pos int, school string, state string, link string")
    inst = spark.createDataFrame([("k1", "Red College", "nowhere", "red.org", None), ("k2", "Blue College", "Texas", "old.org", "https://blue.edu"), ("k4", "Green College", "TX", "green.edu", "https://green.edu"), ("k5", "Blue College", "CA", None, None)], "key string, school string, state string, athletics_domain string, website string")
    out = {r["pos"]: (r["key"], r["verdict"]) for r in L.import_match(rows, inst).collect()}
    assert out == {1: ("k1", "already_known"), 2: ("k2", "conflicting"), 3: (None, "unmatched"), 4: ("k4", "already_known")}


PAGE = """<html><head><title>Acme Plumbing | Home</title><meta property="og:description" content="Pipes and drains for everyone.">
<script type="application/ld+json">{"@graph": [{"@type": "LocalBusiness", "name": "Acme  Ltd", "address": {"streetAddress": "1 High St", "addressLocality": "Town"}}]}</script></head>
<body><script>var t="</p>"; track("555 1234")</script><p>Call <b>us<p>Phone: (231) 555-0199 <pre>8 13 21 34 55</pre><a href="mailto:Info@acme.org?s=1">mail</a><a href="tel:+12315550188">t</a>
<a href="/contact">Contact us</a><a href="https://www.partner.org/x">p</a><a href="https://x.com/acme?y=1">x</a><a rel=next href="?p=2">more</a><a href="/file.pdf">about</a></body></html>"""


def test_page_facts(spark):
    pages = spark.createDataFrame([(1, "https://www.acme.org/", PAGE), (2, "https://acme.org/jobs", "<p>We are hiring"), (3, "https://b.org/", None)], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in H.company_facts(pages).collect()}
    a = out[1]
    assert a["company_name"] == "Acme Ltd" and a["description"] == "Pipes and drains for everyone." and a["emails"] == ["info@acme.org"]
    assert a["phones"] == ["+1 231 555 0188", "+1 231 555 0199"] and a["location"] == "1 High St, Town" and a["next_url"] == "https://www.acme.org/?p=2" and out[3]["company_name"] == "B"
    links = H.page_links(H.facts(pages))
    assert [(r["url"], r["score"]) for r in H.internal_links(links).collect()] == [("https://www.acme.org/contact", 100)]
    assert {r["domain"] for r in H.outbound_domains(links).collect()} == {"partner.org"}
    assert [(r["platform"], r["url"]) for r in H.socials(links).collect()] == [("twitter", "https://x.com/acme")]
    site = {r["domain"]: r for r in H.fold_site(H.company_facts(pages), None).collect()}["acme.org"]
    assert site["pages_crawled"] == 2 and site["has_open_roles"] and site["careers_url"] == "https://acme.org/jobs"
    assert "8 13 21" not in visible_text(parse(PAGE)) and "track" not in visible_text(parse(PAGE))


TABLE = """<html><h2>Staff Directory</h2><table><tr><th>Name</th><th>Title</th><th>Email</th><th>Phone</th></tr><tr><th>Men's Golf - golf@t.edu</th></tr>
<tr><td>Doe, Ann</td><td>Head Coach</td><td><a href="mailto:ann@t.edu">mail</a><td>(231) 555-0199</td></tr><tr><td>TBA</td><td>Coach</td><td></td><td></td></tr>
<tr><td>Bo Li</td><td>Coach<td><script>var firstHalf="bo", secondHalf='t.edu'</script></td></tr><tr><td colspan=4>Media</td></tr><tr><td><a href="/staff/cy">Cy Fox</a></td><td>Director</td><td>cy@t.edu</td><td></td></tr>
<tr><td><a href="/staff/cy">Cy Fox</a></td><td>Director</td><td>desk@t.edu</td><td></td></tr></table>"""
CARDS = "<h3>Soccer</h3>" + "".join(f'<div class="s-person-card s-person-card--list"><div><h4 data-test-id="s-person-details__personal-single-line">P {i}</h4><span class="s-person-details__position">Coach</span><a href="/staff-directory/p-{i}/{i}">bio</a></div></div>' for i in "abcdef")
BLOCKS = "<h2>Tennis</h2>" + "".join(f'<li class="coach"><h3>Al {i}</h3> |  Head Coach | <a href="mailto:{i}@t.edu">m</a></li>' for i in "abcde")


def test_staff_layouts(spark):
    pages = spark.createDataFrame([(1, "https://t.edu/staff", TABLE), (2, "https://c.edu/staff", CARDS), (3, "https://b.edu/staff", BLOCKS), (4, "https://n.edu/", "<p>nothing")], "page_id long, url string, html string")
    out = H.staff_rows(pages, schemas.person(), 3).collect()
    by = {(r["page_id"], r["name"]): r for r in out}
    ann, bo, cy = by[1, "Ann Doe"], by[1, "Bo Li"], by[1, "Cy Fox"]
    assert (ann["sport"], ann["emails"], ann["phones"], ann["is_coach"], ann["shared_email"]) == ("Men's Golf", ["golf@t.edu", "ann@t.edu"], ["+1 231 555 0199"], True, True)
    assert bo["emails"] == ["golf@t.edu", "bo@t.edu"] and (cy["department"], cy["emails"], cy["profile_url"], cy["sport"]) == ("Media", ["cy@t.edu", "desk@t.edu"], "https://t.edu/staff/cy", None)
    assert (1, "TBA") not in by and len([r for r in out if r["page_id"] == 1]) == 3
    assert {r["sport"] for r in out if r["page_id"] == 2} == {"Soccer"} and len([r for r in out if r["page_id"] == 2]) == 6
    assert {(r["sport"], r["title"]) for r in out if r["page_id"] == 3} == {("Tennis", "Head Coach")}
    share = {r["page_id"]: r["athletics"] for r in H.athletics_share(H.staff_rows(pages, schemas.person(), 3)).collect()}
    assert share == {1: True, 2: True, 3: True}


def test_batches(spark):
    out = Q.batches(spark.range(105).withColumn("x", 1000 - F.col("id")).repartition(5), "x", 10).collect()
    assert all((1000 - r["x"] == r["id"]) and r["batch"] == (104 - r["id"]) // 10 for r in out)


def test_filters_push_down(spark, sf):
    from rosterlake.tables import table

    plan = table(spark, sf, "lineitem").where("l_quantity > 40").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan" in plan and "l_comment" not in plan


def test_a_refused_site_falls_back_to_the_college(spark):
    from rosterlake.operators import sites

    row = lambda n, t: f"<tr><td>{n}</td><td>{t}</td><td><a href='mailto:{n[:2].lower()}@x.edu'>m</a></td></tr>"
    page = lambda title, rows: f"<html><title>Staff Directory</title><table><caption>{title}</caption><tr><th>Name</th><th>Title</th><th>Email</th></tr>{''.join(rows)}</table>"
    campus = page("Biology", [row(f"P{k} Prof", "Professor") for k in range(8)] + [row("Co Ach", "Head Baseball Coach")])
    team = page("Golf", [row(f"G{k} Pro", "Coach") for k in range(6)])
    pages = spark.createDataFrame([(1, "https://uni.edu/staff", campus), (2, "https://old.edu/staff", team), (3, "https://go-b.edu/staff", team.replace("Golf", "Tennis"))], "page_id long, url string, html string")
    inst = spark.createDataFrame([("a", "A", "", "go-a.edu", "https://uni.edu"), ("b", "B", "", "go-b.edu", "https://old.edu")], "key string, school string, division string, athletics_domain string, website string")
    tries = spark.createDataFrame([("go-a.edu", 1, "https://go-a.edu/", 403, "", "")], "domain string, seq int, url string, status int, body string, error string")
    seeds = spark.createDataFrame([("uni.edu",), ("old.edu",), ("go-a.edu",)], "domain string")
    people, outcomes = sites.site_people(seeds, pages, tries, schemas.person(), inst)
    got = {r["domain"]: (r["status"], r["people"], r["url"], r["school"]) for r in outcomes.collect()}
    assert got["uni.edu"] == got["go-a.edu"] == ("ok", 1, "https://uni.edu/staff", "A") and got["old.edu"] == ("ok", 6, "https://go-b.edu/staff", "B")
    kept = people.where("seed = 'uni.edu'").collect()
    assert [(r["name"], r["sport"], r["department"], r["notes"]) for r in kept] == [("Co Ach", "Baseball", None, [V.TITLE_NOTE])]


def test_unterminated_references_stay_as_written():
    page = H.page_facts("<title>R&amp;D &copy 5 &ampx; cut&amp</title><body>R&amp;D &foo; end &quot<a href='/x?a=1&copy=2&amp;b=3'>R&D</a><script type='application/ld+json'>{\"@type\":\"Organization\",\"name\":\"A&B\"}</script>", "https://a.org/")
    assert page["title"] == "R&D &copy 5 &ampx; cut&amp"
    assert page["links"][0]["href"] == "/x?a=1&copy=2&b=3" and page["links"][0]["label"] == "R&D" and page["ld_name"] == "A&B"


def test_visible_text_keeps_unterminated_references():
    assert H.page_facts("<body>R&amp;D &foo; end &quot<p>﷐&amp", "https://a.org/")["text"] == "R&D &foo; end &quot ﷐&amp"


def test_only_named_references_are_read():
    page = "<title>a &quot;b&quot; &lt;c&gt; &amp;lt; &#65; &copy;</title>"
    assert H.page_facts(page, "https://a.org/")["title"] == 'a "b" <c> &lt; A ©'
    assert H.page_facts(page, "https://a.org/", ("lt", "gt", "amp"))["title"] == "a &quot;b&quot; <c> &lt; &#65; &copy;"


def test_pages_are_parsed_in_pieces():
    import pyarrow as pa

    html = ["x" * 10] * 200 + [None, "y" * (H.PIECE_BYTES + 5), "z"] + ["w" * (H.PIECE_BYTES // 4)] * 9
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(len(html))), "html": html})
    pieces = [*H._pieces([batch])]
    assert [i for p in pieces for i in p.column("page_id").to_pylist()] == list(range(len(html)))
    assert all(p.num_rows == 1 or p.num_rows <= H.PIECE_PAGES and sum(len(h or "") for h in p.column("html").to_pylist()) <= H.PIECE_BYTES for p in pieces)


def test_visible_text_of_odd_pages_equals_its_sql(spark, tmp_path):
    import duckdb

    from rosterlake.plans import catalog
    from tests.oracle import compare

    odd = [
        None, "", "<p>no body", "<body>a &eacute; &#65; &hellip; &nbsp; &copy; &apos; &amp;lt; &lt;b&gt; &amp", "<body>&nbsp;a&nbsp;&nbsp;b", "<body>a  b ", "<body>a\x0b\x0bb  c\x85　d　 ",
        "<body>a</body>tail</html>more", "<body>a</body><body>b", "<body>5<6, a < b<p>c<d", "<body>a<!-- x", "<body>a<p cla", "<body>a<", "<body>a<!-- x > y -->b<br/>c", "<body>a</b>b</body>\n<script>x</script>\n",
    ]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id bigint, url varchar, html varchar)")
    con.executemany("INSERT INTO pages VALUES (?, 'https://a.org/', ?)", [*enumerate(odd)])
    con.execute(f"COPY pages TO '{tmp_path}/pages.parquet'")
    assert compare(catalog.queries()["visible_text_len"](spark, str(tmp_path)), con, catalog.oracle_sql()["visible_text_len"]) == ""


def test_a_text_is_one_piece():
    page = H.page_facts("<title>1<2</title><body><a href='/x'>a<3</a> 5<6</body> end", "https://a.org/")
    assert page["text"] == "a<3 5<6 end" and page["links"][0]["label"] == "a<3" and page["title"] == "1<2"


def test_asked_facts_alone_are_made(spark):
    pages = spark.createDataFrame([(1, "https://www.acme.org/", PAGE), (2, "https://acme.org/jobs", "<p>We are hiring"), (3, "https://b.org/", None)], "page_id long, url string, html string")
    some, full = H.facts(pages, only=("links",)), H.facts(pages)
    assert some.columns == ["page_id", "url", "links", "error"] and some.collect() == full.select(some.columns).collect()
    assert list(H.page_facts(PAGE, "https://www.acme.org/", only=("title", "links"))) == ["title", "links"]
    assert H.facts(pages, only=("html", "title")).columns == ["page_id", "url", "html", "title", "error"]


@pytest.mark.parametrize("name", ["internal_links_scored", "outbound_domains", "page_socials", "page_links"])
def test_queries_of_links_take_links_alone_from_python(spark, sf, name):
    from rosterlake.plans import catalog

    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().analyzed().toString()
    made = next(x for x in plan.splitlines() if "MapInArrow" in x).rpartition("[")[2]
    assert [c.split("#")[0].strip() for c in made.split("]")[0].split(",")] == ["page_id", "url", "links", "error"]
