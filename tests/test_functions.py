from __future__ import annotations

import difflib

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import people as P
from rosterlake.functions import schools as S
from rosterlake.functions import text as X
from rosterlake.functions import web as W



def check(spark, f, pairs, kind="string"):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], f"i int, x {kind}")
    got = [r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == [b for _, b in pairs]


CASES = [
    (W.normalize_domain, [("https://WWW.Acme.com/about?x=1", "acme.com"), (" 'acme.com:8080' ", "acme.com:8080"), ("acme.com:443", "acme.com"), ("localhost:9/x", "localhost:9"), ("nodots", None), ("", None), (None, None), ("a b.com", None), ("u@acme.com", "acme.com")]),
    (W.clean_phone, [("(231) 555-0199", "+1 231 555 0199"), ("+12315550199", "+1 231 555 0199"), ("+61 2 9876 5432", "+61 2 9876 5432"), ("(805) 922-6966 ext. 3227", "+1 805 922 6966 x3227"), ("1111111111", None), ("1234567", None), ("123456789012345", None), ("031 555 0199", "031 555 0199"), ("+81397466225", "+81397466225"), ("401 232 6828 1", "+1 401 232 6828 x1")]),
    (W.emails_in, [("Write Ann@Team.org, ann@team.org or a@example.com", ["ann@team.org"]), (None, []), ("logo@2x.png", [])]),
    (W.phones_in, [("Phone: (231) 555-0199 or fax 231 555 0188", ["+1 231 555 0199", "+1 231 555 0188"]), ("8 13 21 34 55 89", []), ("call us today and then 231 555 0199", [])]),
    (W.has_open_roles, [("We're HIRING now", True), ("closed", False)]),
    (W.industry_hints, [("A software builder with a cafe", ["construction", "technology", "hospitality"]), ("", [])]),
    (W.looks_like_directory, [("mailto:a " * 5, True), ("mailto:a", False), ("Staff Directory" + "<tr>" * 5, True), (None, False), ("/staff-directory/ann-doe/1 " * 5, False)]),
    (P.is_coaching_title, [("Head Coach", True), ("Coaching staff", True), ("Assistant to the Head Coach", False), ("Director of Operations", False), (None, False)]),
    (P.clean_title, [("ATHLETICS Head Baseball Coach 229-732-5901 ann@team.org", "Head Baseball Coach"), ("Athletics Director", "Athletics Director"), ("Coach Email Phone Full Bio for Ann Doe", "Coach"), ("Office: Manager", "Manager"), ("Office Manager", "Office Manager"), ("a@b.co", None), (None, None)]),
    (P.is_placeholder_name, [("TBA", True), (". TBD", True), ("TBA TBA", True), ("- Vacant -", True), ("", True), (None, True), ("Ann Doe", False)]),
    (P.normalize_person_name, [("Baker,  Alycia", "Alycia Baker"), ("Smith, Jr.", "Smith, Jr."), ("Lee, PhD", "Lee, PhD"), ("#42 Matthew Owens '18", "Matthew Owens"), ("'25 Morgan Huey", "Morgan Huey"), ("O'Melia", "O'Melia"), ("('05) David R", "('05) David R"), ("A, B, C", "A, B, C"), ("'19 '23", "'19 '23")]),
    (P.sport_labels, [("Head Men's Soccer Coach Head Women’s Soccer Coach", ["Soccer"]), ("Men's Swimming & Diving", ["Men's Swimming & Diving"]), ("Women's Asst. Basketball Coach", ["Women's Basketball"]), ("Crew; track and field", ["Rowing", "Track & Field"]), ("flag football", ["Flag Football"]), ("Media", []), (None, [])]),
    (P.sport_from_title, [("Men's and Women's Cross Country", "Men's Cross Country; Women's Cross Country"), ("Dean", None), (None, None)]),
    (P.clean_group, [("Men's Soccer - soccer@team.org", ("Men's Soccer", ["soccer@team.org"])), ("", (None, []))]),
    (P.usable_group, [("Golf", True), ("Staff Directory", False), ("A-D", False), ("x" * 81, False), (None, False)]),
    (P.is_sport, [("Beach Volleyball staff", True), ("Media", False), (None, False)]),
    (S.normalize_division, [("I", "DI"), ("d1", "D1"), ("naia", "NAIA"), ("dnaia", "NAIA"), ("NJCAA DII", "NJCAA"), ("", ""), (None, "")]),
    (S.state_code, [("nj", "NJ"), ("New Jersey", "NJ"), ("zz", None), (None, None)]),
    (S.region_for, [("TX", "South (West South Central)"), ("Quebec", "Canada"), ("x", None)]),
    (S.normalize_name, [("The University of Texas at Austin", "university texas austin"), ("A & M-College", "a and m college"), (None, "")]),
    (S.search_term, [("The University of Red Rock Valley (Main), X", "Red Rock Valley"), ("University", "University")]),
    (S.naia_name, [("British Columbia, University of", "University of British Columbia"), ("Saint X, College", "College of Saint X"), ("Plain", "Plain")]),
    (S.link_text, [("A#b|C d", "C d"), ("A b#c", "A b")]),
    (S.clean_school_name, [("The Official Home of Red Rock College Athletics", "Red Rock College"), ("RR Athletics | Official Athletics Site | Bears", "RR Athletics - Bears"), (None, None)]),
    (S.school_title, [("Campus Directory", None), ("Staff Directory", None), ("Duke Athletics", "Duke Athletics")]),
    (S.association_for, [("NJCAA", "NJCAA"), ("DIII", "NCAA"), ("naia", "NAIA"), ("", None)]),
    (X.slug, [("Ann  O'Doe!", "ann-o-doe")]),
    (X.clean, [(" a   b\n", "a b"), ("  ", None), (None, None)]),
]


@pytest.mark.parametrize("f,pairs", CASES, ids=[f.__name__ for f, _ in CASES])
def test_function(spark, f, pairs):
    check(spark, f, pairs)


def test_packed_and_lists(spark):
    check(spark, lambda c: X.join_unique(c, F.lit("b; a")), [("a; c", "a; c; b"), (None, "b; a"), (";;", "b; a")])
    check(spark, lambda c: X.percent(c, F.lit(8)), [(1, "12%"), (3, "38%"), (0, "0%")], "int")
    check(spark, W.add_phones, [(["+1 231 555 0199", "555 0199", "2315550199", "99"], ["+1 231 555 0199", "99"])], "array<string>")
    check(spark, lambda c: W.ranked_emails(c, F.lit("acme.com")), [(["z@x.com", "hr@x.com", "b@acme.com", "info@acme.com"], ["info@acme.com", "b@acme.com", "hr@x.com", "z@x.com"])], "array<string>")
    check(spark, S.money, [(57360.5, "$57,360"), (0.0, None), (None, None)], "double")


def test_levels(spark):
    check(spark, lambda c: F.concat_ws("/", S.level(c)["association"], S.level(c)["division"]), [("NCAA Division II - East", "NCAA/DII"), ("ncaa  division i", "NCAA/DI"), ("Junior College", "NJCAA/NJCAA"), ("club", "/"), (None, "/")])


def test_sport_filters_differ(spark):
    rows = spark.createDataFrame([("Women's Basketball", None), ("Basketball", None), (None, "Basketball Operations"), ("strength", None)], "sport string, department string")
    match = lambda n: [r["m"] for r in rows.select(P.sport_match(F.col("sport"), P.sport_labels(F.col("sport")), F.col("department"), n).alias("m")).collect()]
    assert match("basketball") == [True, True, True, False]
    assert match("Men's Basketball") == [False, False, False, False]
    assert match("strength") == [False, False, False, True] and match("") == [True] * 4
    run = [r["m"] for r in rows.select(P.wanted_at_run(F.lit(True), F.col("sport"), F.col("department"), "men's basketball", False).alias("m")).collect()]
    assert run == [True, False, False, False]


def test_similarity_is_difflib(spark):
    from rosterlake.operators.lookups import similarity

    pairs = [("red rock", "rock red"), ("abcd", "bcde"), ("", "x"), ("same", "same")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r["r"] == difflib.SequenceMatcher(None, r["a"], r["b"]).ratio() for r in got)


def test_sports_in_text(spark):
    from rosterlake.functions import people as P

    rows = [
        ("Head Men's Basketball Coach", "Men's Basketball"), ("Women’s Swimming and Diving", "Women's Swimming; Diving"), ("Mens & Womens track and field / CROSS  COUNTRY", "Men's Track & Field; Women's Track & Field; Cross Country"),
        ("Coach of women: soccer, golf", "Women's Soccer; Women's Golf"), ("Boys and girls of golf", "Golf"), ("Footballer", None), (None, None), ("beach volleyball; volleyball", "Beach Volleyball; Volleyball"), ("Crew, men's crew", "Crew; Men's Crew"),
    ]
    df = spark.createDataFrame(rows, "t string, want string").select("want", P.sport_from_title(F.col("t")).alias("got"), P.sport_labels(F.col("t")).alias("labels")).collect()
    assert [r["got"] for r in df] == [r["want"] for r in df]
    assert df[1]["labels"] == ["Women's Swimming & Diving"] and df[2]["labels"] == ["Track & Field", "Cross Country"] and df[8]["labels"] == ["Men's Rowing"] and df[5]["labels"] == []


def test_labels_and_brackets_go_however_many(spark):
    from rosterlake.functions import people as P

    title = "Head Coach" + " | Full Bio | Email; Phone / profile" * 5
    row = spark.createDataFrame([(title, "Ann Doe ([ (")], "t string, n string").select(P.clean_title(F.col("t")).alias("t"), P.strip_decorations(F.col("n")).alias("n")).first()
    assert tuple(row) == ("Head Coach", "Ann Doe")
