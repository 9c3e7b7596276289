"""Discovery beside a walk that asks for one page after another."""

from __future__ import annotations

import random

from rosterlake import schemas
from rosterlake.functions import vocabulary as V
from rosterlake.operators.discovery import discover

PEOPLE = ["Ann Lee", "Bo Ray", "Cy Fox", "Di Orr", "Ed Poe", "Flo Day"]


def listing(group: str, titles: list[str]) -> str:
    rows = "".join(f"<tr><td>{n}</td><td>{t}</td><td><a href='mailto:{n[:2].lower()}@x.edu'>m</a></td></tr>" for n, t in zip(PEOPLE, titles))
    return f"<title>Staff Directory</title><table><tr><th>Name</th><th>Title</th><th>Email</th></tr><tr><th>{group}</th></tr>{rows}</table>"


ATHLETICS, GENERAL, CLERKS, SPORT = listing("Men's Golf", ["Head Coach"] * 6), listing("Media", ["Clerk"] * 5 + ["Head Coach"]), listing("Media", ["Clerk"] * 6), listing("Golf", ["Head Coach"] * 2)
KIND = {ATHLETICS: "athletics", GENERAL: "general", CLERKS: "clerks", SPORT: "sport", "": "empty"}


def make_site(r: random.Random, host: str, other: str, web: dict, fronts: dict) -> None:
    """A front page with links, an athletics host or sports, and some pages where directories may be."""
    links = r.sample(["/a/our-staff", "/b/coaches", "/c/directory"], r.randrange(3))
    sports = sorted(r.sample(["golf", "rowing", "tennis", "track-field"], r.choice([0, 0, 2, 4])))
    to = other if other and r.random() < 0.6 else None
    fronts[host] = (links, to, sports)
    names = {"/a/our-staff": "staff directory", "/b/coaches": "Coaches", "/c/directory": "Directory"}
    html = "".join(f"<a href='{p}'>{names[p]}</a>" for p in links) + "".join(f"<a href='/sports/{s}/roster'>x</a>" for s in sports) + (f"<a href='https://www.{to}/home'>Athletics</a>" if to else "")
    web[host] = (r.choice([200] * 9 + [403]), html)
    for p in (*V.DIRECTORY_PATHS, *links):
        if r.random() < 0.15:
            web[host + p] = r.choice([(200, ATHLETICS), (200, GENERAL), (200, GENERAL), (200, CLERKS), (200, ""), (404, ""), (V.ROBOTS_STATUS, "")])
    for s in sports:
        if r.random() < 0.5:
            web[f"{host}/sports/{s}/coaches/index"] = (200, r.choice([SPORT, CLERKS, ""]))


def walk(site: str, web: dict, fronts: dict, budget: int):
    """The search as it is told: ask, look, go on."""
    seen, general = [], []

    def ask(place, kind, hop):
        seen.append((hop, kind, place))
        return web.get(place, (0, ""))

    def hunt(host, hop):
        if ask(host, 0, hop)[0] != 200:
            return None
        for p in V.DIRECTORY_PATHS:
            status, html = ask(host + p, 1, hop)
            if status == 200 and html == ATHLETICS:
                return "athletics", host + p
            if status == 200 and html == GENERAL:
                general.append(host + p)
            if status == V.ROBOTS_STATUS:
                return None
        ask(host, 2, hop)
        links, to, sports = fronts[host]
        score = {"/a/our-staff": 100, "/b/coaches": 80, "/c/directory": 70}
        for p in sorted(links, key=lambda p: -score[p]):
            status, html = ask(host + p, 3, hop)
            if status == 200 and html == ATHLETICS:
                return "athletics", host + p
            if status == 200 and html == GENERAL:
                general.append(host + p)
        if hop == 0 and to and (hit := hunt(to, 1)):
            return hit
        first = None
        for s in sports[: max(0, budget - len(seen))]:
            place = f"{host}/sports/{s}/coaches/index"
            status, html = ask(place, 4, hop)
            first = first or (place if status == 200 and html in (SPORT, CLERKS) else None)
        if first:
            return "sports", first
        return ("coaches", general[0]) if general else None

    return seen, hunt(site, 0) or ("none", None)


def test_visits_equal_a_walk(spark):
    r = random.Random(11)
    web, fronts, sites = {}, {}, [f"s{i}.edu" for i in range(60)]
    for i, s in enumerate(sites):
        if i % 2:
            make_site(r, f"go{i}.com", "", web, fronts)
        if i % 13:
            make_site(r, s, f"go{i}.com" if i % 2 else "", web, fronts)
    pages = [(k, f"https://www.{p}/?q=1" if "/" not in p else f"http://{p}", html, status) for k, (p, (status, html)) in enumerate(sorted(web.items()))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, status int")
    ids = {p: k for k, (p, _) in enumerate(sorted(web.items()))}
    visits, outcomes = discover(spark.createDataFrame([(s.upper(),) for s in sites], "domain string"), df, schemas.person(), budget=20)
    got = {}
    for v in visits.orderBy("site", "step").collect():
        got.setdefault(v["site"], []).append((v["hop"], v["kind"], v["place"]))
    out = {o["site"]: (o["found"], o["page_id"], o["place"], o["visits"]) for o in outcomes.collect()}
    ways = set()
    for s in sites:
        seen, (found, place) = walk(s, web, fronts, 20)
        assert got[s] == seen, s
        assert out[s] == (found, ids.get(place), place, len(seen)), s
        ways.add((found, seen[-1][0]))
    assert len(ways) >= 6
