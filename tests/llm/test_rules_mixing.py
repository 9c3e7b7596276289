from __future__ import annotations

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from rosterlake.llm.mixing import exponent, mix
from rosterlake.llm.quality_rules import host_verdicts, quality_filter, quality_rules, with_base
from tests.llm import brute
from tests.llm.test_dedup import empty, odd, odd_rows, prose  # noqa: F401


def test_quality_rules(spark):
    block = "one two three four five six seven eight nine ten"
    rows = [(i, t, "h" if (i or 0) % 2 else None) for i, t in odd_rows()]
    rows += [(30, f"{block}\n{block}\nx {block} y\n  \n{block}", "h"), (31, "# a*b $ %\n# a*b $ %\n\n", None), (32, " ".join(["w"] * 40), "h"), (33, "a b c d e f g h", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_words", F.lit(1))
    out = quality_rules(df).collect()
    got = sorted(((r["doc_id"], r["_n_words"], r["_word_chars"], r["_n_symbols"], r["_n_dup_lines"], r["_n_repeat_words"]) for r in out), key=str)
    assert got == sorted(((i, *brute.rules(t)) for i, t, _ in rows), key=str)
    for r in out:
        assert r["_base_failed"] == (r["_n_words"] < 20 or 100 * r["_n_repeat_words"] > 30 * r["_n_words"])
        assert not (r["_kept"] and r["_base_failed"])
    assert quality_rules(empty(df)).count() == 0


def test_hosts_are_shrunk_and_rejected(spark):
    rows = [("bad", True)] * 90 + [("bad", False)] * 2 + [("good", False)] * 300 + [("good", True)] * 10 + [("tiny", True)] + [(None, False)] * 50
    v = {r["source"]: r for r in host_verdicts(spark.createDataFrame(rows, "source string, _base_failed boolean"), "source").collect()}
    f, n = {"bad": 90, "good": 10, "tiny": 1, None: 0}, {"bad": 92, "good": 310, "tiny": 1, None: 50}
    m = sum(f.values()) / sum(n.values())
    var = sum(n[h] * (f[h] / n[h]) ** 2 for h in f) / sum(n.values()) - m * m
    w = min(1e6, max(1.0, m * (1 - m) / var - 1))
    for h in f:
        assert math.isclose(v[h]["_host_rate"], (f[h] + m * w) / (n[h] + w))
    assert not v["bad"]["_host_ok"] and v["good"]["_host_ok"] and v["tiny"]["_host_ok"] and v[None]["_host_ok"]


def test_a_host_is_bad_beside_the_corpus(spark):
    """A host that fails twenty times as often as the corpus goes, one of few rows or one like all others stays."""
    make = lambda host, bad, n: [(host, k < bad) for k in range(n)]
    ok = lambda rows: {r["source"]: r["_host_ok"] for r in host_verdicts(spark.createDataFrame(rows, "source string, _base_failed boolean"), "source").collect()}
    rows = [r for k in range(10) for r in make(f"h{k}", 8, 400)]
    v = ok(rows + make("bad", 80, 200) + make("few", 2, 5))
    assert not v.pop("bad") and all(v.values())
    assert all(ok([r for k in range(5) for r in make(f"h{k}", 60 + k, 100)]).values())


def test_quality_filter_keeps_columns(spark):
    rows = [(1, prose(1, 60), "a", 1), (2, "too short", "a", 2), (None, prose(2, 60), None, 3), (4, None, "a", 4), (5, prose(1, 60), "a", 5), (5, prose(1, 60), "a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _base_failed int")
    out = quality_filter(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([1, None, 5, 5], key=str)
    assert quality_filter(empty(df)).count() == 0


def _docs(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randint(1, 60)), s) for i, s in enumerate(["big"] * 900 + ["mid"] * 200 + ["low"] * 60 + [None] * 15)]
    rows += [(5000, None, "big"), (None, "a b", "mid"), (5001, "", "empty"), (3, rows[3][1], "big")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("blocks", F.lit(9))


def test_mixing_budgets(spark):
    rows, df = _docs(spark)
    tokens, docs = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
        docs[s] += 1
    out = mix(df, max_repeats=3.0, block=16).collect()
    total = sum(tokens.values())
    a = 1 - math.log(3) / math.log(max(tokens.values()) / min(t for t in tokens.values() if t))
    z = sum((t / total) ** a for t in tokens.values() if t)
    scale = max((t / total) ** (1 - a) for t in tokens.values() if t) * z * total
    got, epochs = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in out:
        got[r["source"]] += r["_tokens"]
        epochs[r["source"]][r["_epoch"]] += 1
    for s, t in tokens.items():
        if not t:
            assert epochs[s] == {0: docs[s]}
            continue
        want = scale * (t / total) ** a / z
        assert want - 61 <= got[s] <= want + 1, s
        assert epochs[s][0] == docs[s]  # nothing is dropped
        assert max(epochs[s]) <= 3
    assert mix(empty(df)).count() == 0
    assert set(df.columns) < set(out[0].asDict())


def test_mixing_is_deterministic(spark):
    _, df = _docs(spark)
    key = lambda rows: sorted(((r["doc_id"], r["source"], r["_epoch"], r["_block"], r["_place"]) for r in rows), key=str)
    assert key(mix(df).collect()) == key(mix(df.repartition(7)).collect())


def test_fixed_budget_drops_by_block(spark):
    rows, df = _docs(spark)
    total = sum(len((t or "").split()) for _, t, _ in rows)
    out = mix(df, max_repeats=2.0, budget=total // 2, block=16).collect()
    assert abs(sum(r["_tokens"] for r in out) - total // 2) < 61 * 5


def test_exponent(spark):
    totals = spark.createDataFrame([(1000,), (100,), (10,)], "t long")
    entropy = lambda a: (lambda w: -sum(x * math.log(x) for x in w))([t**a / sum(u**a for u in (1000, 100, 10)) for t in (1000, 100, 10)])
    a = exponent(totals, target_entropy=0.8)
    assert abs(entropy(a) - 0.8) < 1e-6
    assert abs(exponent(totals, max_repeats=10.0) - 0.5) < 1e-6
    assert exponent(totals, max_repeats=0.5) == 1.0 and exponent(totals) == 1.0
    assert exponent(totals, target_entropy=2.0) == 0.0


def test_with_base_is_plain(spark):
    assert with_base(spark.createDataFrame([(20, 6), (20, 7)], "_n_words long, _n_repeat_words long")).where("_base_failed").count() == 1


def test_mixing_by_definition(spark):
    """Every reading of a mixture with a budget of 1.6 passes, beside a plain version of blocks, permutations and the cut."""
    r = random.Random(14)
    rows = [(k if k % 7 else None, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 30))), ("a", "a", "a", "b", None)[k % 5]) for k in range(300)] + [(1, "twice", "b")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tokens = [len(t.split()) for _, t, _ in rows]
    seed, size, budget = 5, 16, 1.6 * sum(tokens)
    out = mix(docs, budget=budget, max_repeats=None, seed=seed, block=size).collect()
    h = lambda *c: F.xxhash64(*c)
    key = [x["k"] for x in docs.select(h(F.lit(seed), F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).alias("k")).collect()]
    turn = {x["k"]: x["t"] for x in spark.createDataFrame([(k,) for k in set(key)], "k long").select("k", h(F.lit(1).cast("long"), "k").alias("t")).collect()}
    perm = {x["b"]: x["h"] for x in spark.range(100).select(F.col("id").alias("b"), h(F.lit(seed), F.lit(1).cast("long"), "id").alias("h")).collect()}
    want = []
    for s in ("a", "b", None):
        mine = [k for k, x in enumerate(rows) if x[2] == s]
        blocks, t = -(-len(mine) // size), sum(tokens[k] for k in mine)
        left = int(budget * t / sum(tokens) - t + 1e-6)  # one whole pass, then so many tokens of another
        block, n = {k: key[k] % blocks for k in mine}, {k: 1 for k in mine}
        for b in sorted(set(block.values()), key=lambda b: (perm[b], b)):
            inside = sorted((k for k in mine if block[k] == b), key=lambda k: (turn[key[k]], key[k]))
            whole = sum(tokens[k] for k in inside)
            room = max(0, min(whole, left))
            left -= whole
            run = 0
            for k in inside:
                same = [j for j in inside if turn[key[j]] == turn[key[k]]]
                run = sum(tokens[j] for j in inside if turn[key[j]] <= turn[key[k]])
                n[k] += (room == whole and whole > 0) or (0 < room < whole and run <= room)
                assert len(same) == 1 or len({rows[j] for j in same}) == 1
        want += [(*rows[k], e, block[k]) for k in mine for e in range(n[k])]
    assert sorted(((x["doc_id"], x["text"], x["source"], x["_epoch"], x["_block"]) for x in out), key=str) == sorted(want, key=str)
    assert len({x["_place"] for x in out}) >= len(set(want)) - 1


def test_blocks_are_summed_by_ranges(spark, monkeypatch):
    """Sources of many blocks, and a text that a third of them are: the same readings whatever the ranges are."""
    from rosterlake.llm import mixing

    rows = [(i, "w " * (i % 7 + 1), "a" if i % 3 else "b") for i in range(400)] + [(7, "again and again", "a")] * 150
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = []
    for size in (mixing.RANGE, 3):
        monkeypatch.setattr(mixing, "RANGE", size)
        out.append(sorted(map(tuple, mixing.mix(df, target_entropy=0.68, budget=2500, block=4).select("doc_id", "source", "_epoch", "_block", "_place").collect())))
    assert out[0] == out[1] and len(out[0]) > 400
