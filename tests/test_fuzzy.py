"""Fuzzy matching reads every part and equals difflib."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import functions as F

from rosterlake.functions import schools as S
from rosterlake.operators import lookups as L
from rosterlake.plans import reading
from rosterlake.tables import table


def test_fuzzy_matches_every_part(spark, sf):
    got = {r["pos"] for r in reading.fuzzy_top1_match(spark, sf).collect()}
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("cid"), F.col("p_name").alias("name"), F.col("p_brand").alias("state"))
    want = L.fuzzy_top1(part.select(F.col("cid").alias("pos"), F.concat("name", F.lit(" University-Main Campus")).alias("name"), "state"), part)
    assert got == {r["pos"] for r in want.collect()} and len({k % 10 for k in got}) == 10


def test_fuzzy_top1_is_difflib(spark):
    names = ["Red River", "Red Rivers", "Red Rock", "Blue Lake", "Blue Lakes North", "Redd River"]
    cand = spark.createDataFrame([(i, n, "TX" if i != 4 else None) for i, n in enumerate(names)], "cid int, name string, state string")
    goal = spark.createDataFrame([(i, n + " University-Main Campus", s) for i, (n, s) in enumerate([("Red River", "TX"), ("Red Rockk", "TX"), ("Blue Lake", "TX"), ("Blue Lake", None), ("Red River", "CA"), ("Green", "TX")])], "pos int, name string, state string")
    part = lambda df: [(*r[:3], r["k"], (r["t"] or "").split(" ")[0].lower()) for r in df.select("*", S.fuzzy_key(F.col("name")).alias("k"), S.search_term(F.col("name")).alias("t")).collect()]
    cs, want = part(cand), {}
    for pos, _, state, key, block in part(goal):
        scored = [(difflib.SequenceMatcher(None, key, k).ratio(), -cid) for cid, _, s, k, b in cs if s == state and b == block]
        if scored and max(scored)[0] >= 0.6:
            want[pos] = (-max(scored)[1], round(max(scored)[0], 6))
    assert {r["pos"]: (r["cid"], round(r["score"], 6)) for r in L.fuzzy_top1(goal, cand).collect()} == want and len(want) >= 4


def test_bounds_leave_out_nobody(spark):
    """Random names in few blocks: what the letters rule out can't win, and few pairs are left to compare."""
    import random

    r = random.Random(3)
    name = lambda: r.choice(["Red", "Blue"]) + " " + " ".join("".join(r.choice("abcdeé-") for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(0, 4)))
    cand = [(i, name(), r.choice(["TX", None])) for i in range(150)]
    goal = [(i, name() + r.choice(["", " University", " College of the Lakes"]), r.choice(["TX", None, "CA"])) for i in range(120)]
    cand += [(900 + i, *cand[i][1:]) for i in range(20)]  # repeated names: the smaller id wins
    key = lambda n: re.sub("[^a-z0-9]+", " ", re.sub(r"\b(?:the|university|college|campus|of|at|and)\b", " ", n.lower())).strip()
    want = {}
    for pos, n, state in goal:
        scored = [(difflib.SequenceMatcher(None, key(n), key(m)).ratio(), -c) for c, m, s in cand if s == state and m.split(" ")[0] == n.split(" ")[0]]
        if scored and max(scored)[0] >= 0.6:
            want[pos] = (-max(scored)[1], round(max(scored)[0], 6))
    c, g = (spark.createDataFrame(x, f"{k} int, name string, state string") for x, k in ((cand, "cid"), (goal, "pos")))
    assert {x["pos"]: (x["cid"], round(x["score"], 6)) for x in L.fuzzy_top1(g, c).collect()} == want and len(want) > 60


def test_no_ratio_is_over_its_bound(spark):
    words = ["", "a", "ab ba", "abc cab bca", "red river 12", "river red 21", "zz top"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for x in df.select("a", "b", L.most_similar(F.col("a"), F.col("b"), L.letter_counts(F.col("a")), L.letter_counts(F.col("b"))).alias("top")).collect():
        assert difflib.SequenceMatcher(None, x["a"], x["b"]).ratio() <= x["top"] + 1e-12
