"""Headings over elements, by intervals of positions; pages that can't be parsed; cards within cards."""

from __future__ import annotations

import random
import re

from rosterlake import schemas
from rosterlake.functions import vocabulary as V
from rosterlake.operators import html as H
from rosterlake.operators.dom import Node, parse
from rosterlake.operators.outline import Outline


def spans(root: Node) -> dict[int, tuple[int, int]]:
    out, clock = {}, 0

    def visit(n):
        nonlocal clock
        begin = clock = clock + 1
        for c in n.children:
            if isinstance(c, Node):
                visit(c)
        out[id(n)] = (begin, clock)

    visit(root)
    return out


def over(root: Node, target: Node) -> str | None:
    """Of the elements that end before the target and whose parent holds it, the last one that says something."""
    at = spans(root)
    every = list(root.walk())
    begin = at[id(target)][0]
    near = [n for n in every if at[id(n)][1] < begin and at[id(n.parent)][0] < begin <= at[id(n.parent)][1]]
    for n in sorted(near, key=lambda n: -at[id(n)][0]):
        inner = list(n.walk())
        hrefs = [x.get("href") for x in inner if x.tag == "a" and x.get("href")]
        people = {p for h in hrefs if (p := H._profile(h))}
        if sum(h.startswith("mailto:") for h in hrefs) == 1 or sum(x.get("data-test-id") == V.CARD_NAME for x in inner) == 1 or len(people) == 1:
            continue
        heads = [n] if n.tag in ("h1", "h2", "h3", "h4", "h5", "caption") else []
        heads += [x for x in inner if x.tag in ("h1", "h2", "h3", "h4", "caption")][-1:]
        for h in heads:
            if (text := h.shown()) and not re.match(V.GENERIC_HEADING, text):
                return text[:120]
    return None


def random_page(r: random.Random, depth: int = 0) -> str:
    kinds = ["h2", "h3", "h5", "caption", "div", "section", "a", "table", "empty"]
    out = ""
    for _ in range(r.randrange(1, 5)):
        k = r.choice(kinds)
        if k in ("h2", "h3", "h5", "caption"):
            out += f"<{k}>{r.choice(['Golf', 'Swimming', 'Staff Directory', '', 'Tennis ' * 40])}{r.randrange(99)}</{k}>" if r.random() < 0.8 else f"<{k}><span></span></{k}>"
        elif k == "a":
            out += f"<a href='{r.choice(['mailto:x@a.edu', '/staff-directory/ann/7', '/roster/coaches/bo/9?x=1', '/news', 'tel:1'])}'>x</a>"
        elif k == "table":
            out += "<table><tr><td>x</td></tr></table>"
        elif k == "empty":
            out += f"<span data-test-id='{V.CARD_NAME}'>N</span>" if r.random() < 0.3 else "<br>"
        elif depth < 5:
            out += f"<{k}>{random_page(r, depth + 1)}</{k}>"
    return out


def test_headings_equal_their_definition():
    r = random.Random(6)
    said = 0
    for _ in range(150):
        root = parse(random_page(r))
        outline = Outline(root, H._profile)
        for n in root.walk():
            assert outline.over(n) == over(root, n)
            said += outline.over(n) is not None
    assert said > 500


def test_deep_pages_have_no_level_limit():
    page = "<h2>Rowing</h2>" + "<div>" * 3000 + "<table><tr><td>x</td></tr></table>"
    root = parse(page)
    assert Outline(root, H._profile).over(root.find("table")[0]) == "Rowing"


CARD = "<div class='s-person-card {}'><span data-test-id='" + V.CARD_NAME + "'>{}</span><p class='" + V.CARD_TITLE + "'>Head Coach</p>{}</div>"


def test_outermost_cards_of_the_first_mark(spark):
    page = "<h2>Golf</h2>" + CARD.format("s-person-card--list", "Ann Lee", CARD.format("s-person-card--list", "Inner One", "")) + CARD.format("s-person-card--list", "Bo Ray", "") + CARD.format("", "Other Mark", "")
    plain = CARD.format("", "Cy Fox", "") + CARD.format("", "", "") + "<ul><li><a href='mailto:d@a.edu'>Dee Day</a></li></ul>"
    pages = spark.createDataFrame([(1, "https://a.edu/staff", page), (2, "https://a.edu/c", plain)], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["pos"], r["raw_name"], r["raw_title"], r["raw_group"]) for r in H.raw_staff(pages).collect())
    assert got == [(1, 0, "Ann Lee", "Head Coach", "Golf"), (1, 1, "Bo Ray", "Head Coach", "Golf"), (2, 0, "Cy Fox", "Head Coach", None)]


def test_page_that_fails_is_kept_with_its_error(spark):
    """urljoin refuses an address with an open bracket; the other pages come through, and no page is parsed twice."""
    table = "<table><tr><th>Name</th><th>Title</th></tr><tr><td>Ann Lee</td><td>Head Coach</td></tr></table>"
    bad = "<table><tr><th>Name</th><th>Title</th></tr><tr><td><img src='http://[x'>Bo</td><td>Coach</td></tr></table>"
    pages = spark.createDataFrame([(1, "https://a.edu/staff", table), (2, "https://b.edu/staff", bad), (3, "https://c.edu/", None)], "page_id long, url string, html string")
    raw = H.raw_staff(pages)
    got = {r["page_id"]: (r["raw_name"], (r["error"] or "").split(":")[0]) for r in raw.collect()}
    assert got == {1: ("Ann Lee", ""), 2: (None, "ValueError")}
    assert raw._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    people, errors = H.staff_and_errors(pages, schemas.person(), 0)
    assert [r["name"] for r in people.collect()] == ["Ann Lee"] and [r["page_id"] for r in errors.collect()] == [2]


def _same_without_settling(page: str) -> int:
    settled = [n.settled is not None for n in parse(page, H._settle("https://a.edu/")).walk()]
    got, keep = H.staff_parts(page, "https://a.edu/"), H._settle
    H._settle = lambda base: None
    try:
        assert got == H.staff_parts(page, "https://a.edu/")
    finally:
        H._settle = keep
    return sum(settled)


def test_rows_that_only_are_rows_let_their_elements_go():
    row = "<tr><td>Ann Lee<td>Coach</td><td><a href='mailto:a@a.edu'>m</a><a href='/coaches/ann-lee'>p</a></tr>"
    rows = row * 500
    tree = parse(f"<h2>Golf</h2><table><tr><th>Name<th>Title</tr>{rows}</table>", H._settle("https://a.edu/"))
    assert sum(1 for _ in tree.walk()) == 503  # the heading, the table and the rows
    assert _same_without_settling(f"<h2>Golf</h2><table><tr><th>Name<th>Title</tr>{rows}</table>") == 501
    held = ["<li>{}</li>", "<h2>{}", "<div class=staff>{}</div>", "<div class='s-person-card'>{}</div>"]
    assert all(_same_without_settling(x.format(f"<table>{row}</table>")) == 0 for x in held)
    inside = f"<table><tr><td><table>{row}</table></td></tr><tr><td><h3>Golf</h3></tr></table>"
    assert _same_without_settling(inside) == 0
