from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rosterlake.llm.graph import connected_components
from rosterlake.llm.phrase_dedup import phrase_dedup
from rosterlake.llm.simhash import allocate, group_bits, near_links, simhash_components, simhash_keep_one
from rosterlake.llm.suffix_dedup import suffix_dedup
from tests.llm import brute


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abdeiklmnoprstuéß") for _ in range(r.randint(2, 7))) for _ in range(n))


def odd_rows():
    """Nulls, blanks, short and long texts, exact and near copies, repeats within a text, repeated rows and ids."""
    a, b, shared = prose(1, 160), prose(2, 200), prose(3, 90)
    return [
        (1, a), (2, a), (3, None), (4, ""), (5, " \n\t "), (6, a[:500] + " ZZ " + a[504:]), (None, shared + " " + prose(4, 20)), (7, "short text"), (7, "short text"),
        (8, prose(5, 50) + " " + shared + " " + prose(6, 50)), (9, "x" * 1500), (10, prose(7, 30) + "\n" + shared[3:] + "\n" + prose(8, 10)), (11, b + " " + b), (12, prose(9, 9000)),
        (13, "é" * 700), (14, shared[:420]), (None, None), (8, "other text of the same id " + shared), (15, "The  Cat\tsat on THE mat"), (16, "the cat sat on the mat"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(i, t, 5, "x", t, i) for i, t in rows], "doc_id long, text string, _id int, segs string, _kept string, s long")
    return rows, df.repartition(3)


def empty(df):
    return df.where(F.lit(False))


def test_suffix_dedup(odd):
    rows, df = odd
    out = suffix_dedup(df, min_bytes=400)
    assert set(df.columns) <= set(out.columns) and dict(out.dtypes)["_kept"] == "binary"
    got = [(r["doc_id"], len((r["text"] or "").encode()), len((r["text"] or "").encode()) - len(r["_kept"]), len(r["_spans"]), brute.sha(bytes(r["_kept"]))) for r in out.collect()]
    assert sorted(got, key=str) == brute.suffix(rows)
    assert suffix_dedup(empty(df)).count() == 0


def test_suffix_dedup_short_windows(spark):
    """A small alphabet makes grams with very many classes, which are dealt by offset."""
    from rosterlake.llm import suffix_dedup as S

    r = random.Random(4)
    core = "".join(r.choice("ab") for _ in range(14))
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randint(0, 40))) + core + "".join(r.choice("ab") for _ in range(r.randint(0, 40)))) for i in range(200)]
    before, S.DEAL = S.DEAL, 7
    try:
        out = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_bytes=24, gram=12)
        got = [(x["doc_id"], len(x["text"]), len(x["text"]) - len(x["_kept"]), len(x["_spans"]), brute.sha(bytes(x["_kept"]))) for x in out.collect()]
    finally:
        S.DEAL = before
    assert sorted(got, key=str) == brute.suffix(rows, 24)


def test_phrase_dedup(odd):
    rows, df = odd
    out = phrase_dedup(df.withColumnRenamed("segs", "words")).collect()
    got = [(r["doc_id"], r["_words"], sum(s["end"] - s["start"] for s in r["_spans"]), brute.sha(r["_kept"])) for r in out]
    assert sorted(got, key=str) == brute.phrases(rows)
    assert phrase_dedup(empty(df)).count() == 0


def thue_morse(n):
    """Two words of n bytes, complements of each other, that every polynomial hash modulo 2**64 takes for equal."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_phrase_dedup_unlike_words_of_equal_hash(spark):
    a, b = thue_morse(2048)
    rows = [(1, " ".join([a] * 13)), (2, " ".join([b] * 13)), (3, " ".join([a] * 6 + [b] + [a] * 6)), (4, " ".join([b] * 14))]
    got = [(x["doc_id"], x["_words"], sum(s["end"] - s["start"] for s in x["_spans"]), brute.sha(x["_kept"])) for x in phrase_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute.phrases(rows)


def test_suffix_dedup_unlike_bytes_of_equal_hash(spark):
    a, b = thue_morse(4096)
    rows = [(1, a), (2, b), (3, "x" + a), (4, prose(1, 99) + b[:1000]), (5, b[512:1100])]
    out = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_bytes=400).collect()
    got = [(x["doc_id"], len(x["text"].encode()), len(x["text"].encode()) - len(x["_kept"]), len(x["_spans"]), brute.sha(bytes(x["_kept"]))) for x in out]
    assert sorted(got, key=str) == brute.suffix(rows)


def test_many_rows_of_one_id(spark):
    """Rows without an id are told apart by the whole hash of their text."""
    shared = prose(11, 14)
    rows = [(1, prose(12, 20) + " " + shared)] + [(None, prose(100 + k, 15)) for k in range(4000)] + [(None, prose(5000 + k, 8) + " " + shared + " " + prose(9000 + k, 3)) for k in range(40)]
    out = phrase_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(x["doc_id"], x["_words"], sum(s["end"] - s["start"] for s in x["_spans"]), brute.sha(x["_kept"])) for x in out.collect()]
    assert sorted(got, key=str) == brute.phrases(rows)


def test_very_long_texts(spark):
    """Texts that are read in pieces: repeats inside one, across its pieces' edges and with a short text."""
    a = prose(21, 900_000)
    assert len(a) > 4 << 20
    edge = (2 << 20) - 150
    rows = [(1, a), (2, a[edge : edge + 300]), (3, "§ " + a[3_000_000:3_000_500] + " §"), (4, prose(22, 50)), (5, "y" * (5 << 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(x["doc_id"], x["_words"], sum(s["end"] - s["start"] for s in x["_spans"]), brute.sha(x["_kept"])) for x in phrase_dedup(df).collect()]
    assert sorted(got, key=str) == brute.phrases(rows)
    out = {x["doc_id"]: [(s["start"], s["end"]) for s in x["_spans"]] for x in suffix_dedup(df, min_bytes=64).collect()}
    b = a.encode()
    assert out[2] == [(0, len(rows[1][1].encode()))] and out[5] == [(0, 5 << 20)] and out[4] == []
    own = {}
    for k in range(len(b) - 63):
        own.setdefault(hash(b[k : k + 64]), []).append(k)
    planted = [(m := b.find(rows[1][1].encode()), m + len(rows[1][1].encode())), (m := b.find(a[3_000_000:3_000_500].encode()), m + len(a[3_000_000:3_000_500].encode()))]
    assert max(map(len, own.values())) == 1 and out[1] == sorted(planted)


def test_pieces_cover_each_window_once():
    r = random.Random(8)
    import numpy as np
    import pyarrow as pa

    from rosterlake.llm import blocks as B

    for _ in range(30):
        text = "".join(r.choice("ab  \n") for _ in range(r.randint(0, 400)))
        batch = pa.record_batch({"text": [text]})
        words, seen = text.split(), []
        for _, buf, off, first in B.word_pieces([batch], 3, target=40):
            start, end, _ = B.words(buf, off)
            got = [buf[x:y].tobytes().decode() for x, y in zip(start, end)]
            assert got == words[first : first + len(got)]
            seen += range(first, first + len(got) - 3)
        assert seen == list(range(max(0, len(words) - 3)))
        byte = []
        for _, buf, off, at in B.pieces([batch], 9, target=40):
            assert buf.tobytes() == text.encode()[at : at + len(buf)]
            byte += range(at, at + len(buf) - 9)
        assert byte == list(range(max(0, len(text) - 9)))
    assert np.all(B.joined(np.frombuffer(b"ab  c", np.uint8), np.array([0, 4]), np.array([2, 5]))[0] == np.frombuffer(b"ab c", np.uint8))


def test_phrase_dedup_hot_gram(spark):
    from rosterlake.llm import phrase_dedup as P

    r = random.Random(5)
    word = lambda: r.choice("abcd")
    rows = [(i, " ".join([*(word() for _ in range(r.randint(0, 25))), *"p q r s".split(), *(word() for _ in range(r.randint(0, 25)))])) for i in range(150)]
    before, P.DEAL = P.DEAL, 5
    try:
        out = phrase_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=8, gram=4, shard=10).collect()
    finally:
        P.DEAL = before
    got = [(x["doc_id"], x["_words"], sum(s["end"] - s["start"] for s in x["_spans"]), brute.sha(x["_kept"])) for x in out]
    assert sorted(got, key=str) == brute.phrases(rows, 8)


def test_simhash(odd):
    rows, df = odd
    out = simhash_components(df).collect()
    prints = [(i, brute.fingerprint(t)) for i, t in rows]
    assert sorted(((r["doc_id"], r["_fp"] & (1 << 64) - 1) for r in out), key=str) == sorted(prints, key=str)
    assert sorted(((r["doc_id"], r["_component"]) for r in out), key=str) == brute.components(prints)
    assert simhash_components(empty(df)).count() == 0
    stay = simhash_keep_one(df)
    assert stay.columns == df.columns
    want = {c for _, c in brute.components(prints)}
    assert {r["doc_id"] for r in stay.collect()} == want and stay.count() == brute.groups(prints)


@pytest.mark.parametrize("hot", [20_000, 10, 2])
def test_near_links_reach_all(spark, hot):
    """Clusters of close fingerprints, in buckets small and hot: the same components as all pairs give."""
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(12)]
    prints = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(60)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot=hot)
    comp = {r["node"]: r["root"] for r in connected_components(links).collect()}
    got = sorted((x & (1 << 64) - 1, min(y & (1 << 64) - 1 for y in signed if comp.get(y, y) == comp.get(x, x))) for x in signed)
    assert got == sorted(_least(prints))


def _least(prints):
    ps = sorted(prints)
    label = {p: p for p in ps}
    changed = True
    while changed:
        changed = False
        for a in ps:
            for b in ps:
                if (a ^ b).bit_count() <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label.items()


def test_thresholds_cover_distance():
    import numpy as np

    r = np.random.default_rng(1)
    bits = (r.random((500, 64)) < r.random(64)).astype(float)
    both = bits.T @ bits
    for parts in (2, 3, 4, 5):
        groups = group_bits(both, 500.0, parts)
        assert sorted(b for g in groups for b in g) == list(range(64)) and len(groups) == parts
        _, ts = allocate(groups, np.diag(both) / 500, 1e6, 2)
        assert sum(ts) == 2 - parts + 1 and min(ts) >= -1


def test_components_chain_and_star(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 140)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def _contexts(n, passage, words):
    """One passage in n contexts that differ in every word around it."""
    r = random.Random(n)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    return [(i, " ".join([*(word() for _ in range(words)), passage, *(word() for _ in range(words))])) for i in range(n)]


def test_one_passage_in_very_many_contexts(spark, monkeypatch):
    """A hot passage is one row before anything is dealt: no group of a stream is far over DEAL, and results are those of brute force."""
    from rosterlake.llm import phrase_dedup as P

    passage = "the very same thirteen words stand here in each of all the many texts"
    rows = _contexts(20_000, passage, 12)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    seen, make = [], P.hot_streams

    def watched(segments, window):
        streams, made = make(segments, window)
        seen.append(streams.groupBy("a", "part", "slice").count().agg({"count": "max"}).first()[0])
        return streams, made

    monkeypatch.setattr(P, "hot_streams", watched)
    got = [(x["doc_id"], x["_words"], sum(s["end"] - s["start"] for s in x["_spans"]), brute.sha(x["_kept"])) for x in phrase_dedup(df).collect()]
    assert sorted(got, key=str) == brute.phrases(rows)
    assert len(seen) == 1 and seen[0] <= 2 * P.DEAL


def test_one_string_in_very_many_contexts(spark):
    """The same for bytes: what one bucket would hold is counted by windows instead."""
    from rosterlake.llm import suffix_dedup as S

    rows = _contexts(6000, prose(77, 75)[:430], 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    tables, make = [], S.hot_buckets

    def watched(texts):
        hot = make(texts)
        left = texts.join(hot, ["lead", "part", "core"], "left_anti").groupBy("lead", "part", "core").count().agg({"count": "max"}).first()[0] or 0
        tables.append((hot.count(), left))
        return hot

    S.hot_buckets = watched
    try:
        out = suffix_dedup(df, min_bytes=400).collect()
    finally:
        S.hot_buckets = make
    got = [(x["doc_id"], len(x["text"].encode()), len(x["text"].encode()) - len(x["_kept"]), len(x["_spans"]), brute.sha(bytes(x["_kept"]))) for x in out]
    assert sorted(got, key=str) == brute.suffix(rows)
    assert tables[0][0] > 0 and tables[0][1] <= 2 * S.DEAL


def _few_letters(n, length):
    """A string of two letters in n contexts of its own, and prose in which two rows each share a passage."""
    r = random.Random(31)
    core = "".join(r.choice("ab") for _ in range(14))
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randint(0, 40))) + core + "".join(r.choice("ab") for _ in range(r.randint(0, 40)))) for i in range(n)]
    shared = [prose(300 + k, length) for k in range(n)]
    return rows + [(1000 + i, prose(1000 + i, 3) + " " + shared[i % n] + " " + prose(2000 + i, 3)) for i in range(2 * n)]


def _suffix_result(df, **how):
    out = suffix_dedup(df, **how).collect()
    return sorted([(x["doc_id"], len(x["text"].encode()), len(x["text"].encode()) - len(x["_kept"]), len(x["_spans"]), brute.sha(bytes(x["_kept"]))) for x in out], key=str)


def test_suffix_dedup_gram_shorter_than_leading_bytes(spark):
    """Ranges are made by bytes that all windows of an anchor share, so equal windows meet however many ranges there are."""
    rows = _few_letters(300, 15)
    conf = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = _suffix_result(spark.createDataFrame(rows, "doc_id long, text string"), min_bytes=24)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute.suffix(rows, 24)


def test_suffix_dedup_tasks_follow_the_windows(spark, monkeypatch):
    """Ranges stay apart, so a task of the sort has about TASK windows however large the parts are that Spark puts together; and a gram
    that is dealt by offset ships each window once."""
    from rosterlake.llm import suffix_dedup as S

    rows = _few_letters(300, 8)
    seen, order = [], S.in_ranges

    def watched(cool):
        own = cool.selectExpr("_id", "_th", "explode(sequence(s, s + n - 1)) w").groupBy("_id", "_th", "w").count()
        out = order(cool)
        tasks = [x["n"] for x in out.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect()]
        seen.append((own.agg({"count": "max"}).first()[0], max(tasks), sum(tasks)))
        return out

    monkeypatch.setattr(S, "DEAL", 7)
    monkeypatch.setattr(S, "TASK", 500)
    monkeypatch.setattr(S, "in_ranges", watched)
    got = _suffix_result(spark.createDataFrame(rows, "doc_id long, text string"), min_bytes=24, gram=12)
    assert got == brute.suffix(rows, 24)
    (copies, longest, total), = seen
    assert total > 10 * S.TASK and longest <= 4 * S.TASK and copies == 1
