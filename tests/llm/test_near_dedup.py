"""The pipeline's near-dedup beside brute-force Jaccard similarity."""

from __future__ import annotations

import random

import numpy as np

from rosterlake.llm.near_dedup import bands_of, clusters


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def heads(rows, least=0.8):
    sets = {i: shingles(t) for i, t in rows}
    alike = lambda a, b: a == b or bool(a and b) and len(a & b) / len(a | b) >= least
    left, out = sorted(sets), set()
    while left:
        out.add(left[0])
        queue, left = [left[0]], left[1:]
        while queue:
            d = queue.pop()
            hit = [i for i in left if alike(sets[d], sets[i])]
            queue += hit
            left = [i for i in left if i not in hit]
    return out


def test_near_dedup_is_jaccard(spark):
    import corpus_pipeline as C

    r = random.Random(3)
    word = lambda: "".join(r.choice("abdeiklmnoprstu") for _ in range(7))
    rows = []
    for k in range(40):
        base = [word() for _ in range(200)]
        rows.append((1000 * k, " ".join(base)))
        for n in range(1, 8):  # n words changed: a similarity of 0.95 for one, 0.815 for four, 0.77 for five
            text = list(base)
            for i in range(n):
                text[10 + 25 * i] = word()
            rows.append((1000 * k + n * 7, " ".join(text)) if n in (1, 4, 6) and k % 2 else (1000 * k + 500 + n, " ".join(word() for _ in range(50))))
    rows += [(90_000, None), (90_001, ""), (90_002, " "), (90_003, "One two"), (90_004, "one TWO"), (90_005, "one three"), (90_006, " ".join(["same line"] * 40)), (90_007, " ".join(["same line"] * 60))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [x["doc_id"] for x in C.near_dedup(spark, docs.repartition(3), "").collect()]
    assert sorted(got) == sorted(heads(rows)) and not {1007, 1028} & set(got) and 1042 in got


def test_bands_and_clusters():
    r = np.random.default_rng(5)
    base = [np.unique(r.integers(0, 1 << 63, 900).astype(np.uint64)) for _ in range(200)]
    near = [np.unique(np.append(x[:800], r.integers(0, 1 << 63, 100).astype(np.uint64))) for x in base]  # 0.8 exactly
    met = (bands_of(base) == bands_of(near)).any(axis=1)
    assert met.mean() >= 0.99
    assert (clusters([*base, *near], 0.8) == np.tile(np.arange(200), 2)).all()
    assert (clusters([*base, *near], 0.81) == np.arange(400)).all()


def test_large_components_are_dealt(spark):
    """With blocks of eight classes, groups of near copies, chains and loose candidates come out as when whole."""
    from rosterlake.llm.near_dedup import near_keep_one

    r = random.Random(9)
    word = lambda: "".join(r.choice("abdeiklmnoprstu") for _ in range(7))
    rows = []
    for g in range(3):
        base = [word() for _ in range(150)]
        for k in range(40):  # a group of near copies, and a chain that drifts away from it
            text = list(base)
            text[r.randrange(150)] = word()
            rows.append((g * 1000 + k, " ".join(text)))
        text = list(base)
        for k in range(30):
            text[(k * 5) % 150] = word()
            rows.append((g * 1000 + 100 + k, " ".join(text)))
    rows += [(9000, rows[0][1]), (9001, rows[0][1])]
    docs = spark.createDataFrame(rows + [rows[-1]], "doc_id long, text string").repartition(4)
    got = sorted(x["doc_id"] for x in near_keep_one(docs, hold=8).collect())
    assert got == sorted(heads(rows)) == sorted(x["doc_id"] for x in near_keep_one(docs, few=0).collect())


def test_a_link_between_sets_that_met_different_pivots(spark):
    """Sets 0 and 1, and 2 and 3, are near copies; the one link between the two groups is 1 to 2. Pivots are every set but 1 and 2."""
    import numpy as np
    from pyspark.sql import functions as F

    from rosterlake.llm.graph import connected_components
    from rosterlake.llm.near_dedup import _large

    chain = [np.arange(10 * i, 10 * i + 100, dtype=np.uint64) for i in range(4)]  # neighbours have 90 of 110 in common
    k = 40
    h = {r["c"]: r["h"] for r in spark.range(5000).select(F.col("id").alias("c"), F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(k)).alias("h")).collect()}
    pivot, plain = iter([c for c, v in h.items() if v < 16]), iter([c for c, v in h.items() if v >= 16])
    cls = [next(pivot), next(plain), next(plain), next(pivot)]
    sets = spark.createDataFrame([(7, c, bytearray(x.tobytes()), k) for c, x in zip(cls, chain)], "root long, cls long, set binary, k long")
    roots = {r["node"]: r["root"] for r in connected_components(_large(sets, 0.8, 8)).collect()}
    assert len(roots) == 4 and len(set(roots.values())) == 1


def test_pairs_at_the_threshold_share_a_band():
    import numpy as np

    from rosterlake.llm.near_dedup import bands_of

    r = np.random.default_rng(5)
    missed = 0
    for _ in range(40):
        x = r.integers(0, 1 << 63, (500, 100), dtype=np.uint64)  # 80 of 100 in common, by 10 on either side
        both = bands_of([np.sort(row[part]) for row in x for part in (slice(0, 90), slice(10, 100))])
        missed += int((both[::2] != both[1::2]).all(axis=1).sum())
    assert missed == 0
