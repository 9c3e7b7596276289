from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from rosterlake.llm.importance import resample
from rosterlake.llm.queries import op12_importance_draw
from tests.llm.brute import LOWER, sha

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, ngrams=1):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)]


def draw(docs, bench, ngrams=1, buckets=10_000, least=20, percent=10, seed=2024):
    """By definition: sorted (doc_id, n_features, weight, score, rank)."""
    made = [(d, *features(t, ngrams)) for d, t in docs]
    s = Counter(f % buckets for _, _, fs in made for f in fs)
    t = Counter(f % buckets for x in bench for f in features(x, ngrams)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for d, n, fs in made:
        weight = sum(gain(f % buckets) for f in fs)
        h = int(sha(f"{seed}:{'' if d is None else d}")[:8], 16)
        out.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def odd_docs():
    r = random.Random(8)
    text = lambda: " ".join(r.choice(["Ab", "c9", "é", "mid-dle", "Z", "\x00x", "word", "日本"]) for _ in range(r.randrange(60)))
    docs = [(i, text()) for i in range(120)] + [(5, "again " * 30)] * 7 + [(None, "no id " * 20), (None, "no id " * 20), (200, None), (201, ""), (202, "!!! ###")]
    return docs + [(203, "long É " * 60_000)]


def test_query_equals_definition(spark, tmp_path):
    docs, bench = odd_docs(), ["mid word É", None, "", "c9 " * 9]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, op12_importance_draw(spark, str(tmp_path)).collect()), key=str) == draw(docs, bench)


def test_longer_runs_few_buckets_and_clashing_names(spark):
    docs, bench = odd_docs()[:100], ["mid word", "Ab c9 é"]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(1).alias("_score"), F.lit(2).alias("_place"), F.lit(3).alias("_tie"), F.lit(4).alias("doc_id"))
    target = spark.createDataFrame([(t,) for t in bench], "text string")
    got = resample(df, target, ngrams=3, buckets=50, least_words=5, percent=30, seed=7)
    assert got.columns == ["doc_id", "_place", "_tie", "doc_id", "_n_features", "_weight", "_score", "_rank"]
    assert sorted(((r[0], *r[4:]) for r in got.collect()), key=str) == draw(docs, bench, 3, 50, 5, 30, 7)


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, docs).count() == 0
    assert [tuple(r) for r in resample(docs, none).collect()] == draw([(1, "a b")], [])
