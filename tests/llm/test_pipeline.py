from __future__ import annotations

import random

import pytest

from tests.llm import brute


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Clean texts, junk, copies, near copies and a passage that texts share."""
    word = lambda r: "".join(r.choice("abdeiklmnoprstu") for _ in range(r.randint(3, 8)))
    text = lambda seed, n: (lambda r: " ".join(word(r) for _ in range(n)))(random.Random(seed))
    passage = text(99, 80)
    rows = [(i, text(i, 120), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100, rows[4][1], "en", "s0"), (101, rows[4][1], "en", "s1"), (102, "too short", "en", "s0"), (103, "again and again " * 30, "en", "s1"), (104, None, None, None), (105, "", "en", "s2")]
    rows += [(110 + k, f"{text(200 + k, 60)} {passage} {text(300 + k, 60)}", "en", "s2") for k in range(3)]
    rows += [(120, rows[5][1] + " x", None, None)]
    path = tmp_path_factory.mktemp("docs")
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return rows, str(path)


def test_pipeline(spark, made):
    import corpus_pipeline as C
    from rosterlake.llm.piece_dropout import decode
    from rosterlake.tables import materialise

    rows, path = made
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    at = [docs]
    for k, (_, stage) in enumerate(C.STAGES):
        out = materialise(stage(spark, at[-1], path), "test")
        assert k == 4 or out.columns == names
        at.append(out)
    ruled = {i for i, t, *_ in rows if (m := brute.rules(t))[0] >= 20 and 100 * m[4] <= 30 * m[0]}
    assert {r["doc_id"] for r in at[1].collect()} == ruled
    prints = [(i, brute.fingerprint(t, 5)) for i, t, *_ in rows if i in ruled]
    heads = {c for _, c in brute.components(prints)}
    assert {r["doc_id"] for r in at[2].collect()} == heads
    assert {100, 101} & heads == set() and {110, 111, 112} <= heads
    left = {r["doc_id"]: r["text"] for r in at[3].collect()}
    for i, n, gone, _, h in brute.suffix([(i, t) for i, t, *_ in rows if i in heads], C.PASSAGE):
        assert brute.sha(left[i]) == h and len(left[i]) == n - gone
    read = [r["doc_id"] for r in at[4].collect()]
    assert set(read) == heads and max(read.count(i) for i in heads) <= 2
    final = decode(at[5], "pieces").collect()
    assert sorted((r["doc_id"], r["_decoded"]) for r in final) == sorted((i, left[i]) for i in read)
    assert sorted(r["doc_id"] for r in C.run(spark, path).collect()) == sorted(read)


def test_cut_inside_a_character(spark):
    """Spans are bytes; what is left of a split character goes with them."""
    import corpus_pipeline as C

    a, b = "é" * 300, "x" * 20
    docs = spark.createDataFrame([(1, b + a, "fr", "s", 320), (2, "ü" + a[:250] + "y", "fr", "s", 252), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in C.repeated_text(spark, docs, "").collect()}
    assert out[1]["text"] == b and out[1]["n_chars"] == 20 and out[2]["text"] in ("üy", "y") and out[3]["text"] is None


def test_passage_of_just_over_fifty_words(spark):
    """A passage of 51 short words in two texts goes from both, a clean text stays as it is."""
    import corpus_pipeline as C

    r = random.Random(31)
    word = lambda: "".join(r.choice("abdeiklmnoprstu") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, clean = text(51), text(200)
    rows = [(k, f"{text(70)} {shared} {text(70)}") for k in range(2)] + [(5, clean)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {x["doc_id"]: x for x in C.repeated_text(spark, docs, "").collect()}
    assert out[5]["text"] == clean and all(shared not in out[k]["text"] and out[k]["n_chars"] == len(out[k]["text"]) for k in range(2))
    assert all(len(rows[k][1]) - len(shared) - 20 < len(out[k]["text"]) <= len(rows[k][1]) - len(shared) for k in range(2))


def test_stages_take_empty_tables_and_odd_columns(spark):
    import corpus_pipeline as C
    from rosterlake.tables import materialise

    r = random.Random(4)
    long = " ".join("".join(r.choice("abdeiklmnoprstu") for _ in range(6)) for _ in range(250_000))
    rows = [(1, long, "en", "s", 1), (2, None, None, None, None), (None, "a b c " * 3, "en", None, 18), (1, long, "en", "s", 1)]
    docs = spark.createDataFrame([(*x, 7, "q", 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, _id int, _th string, cls int")
    for df, n in ((docs, 1), (docs.where("false"), 0)):
        for k, (_, stage) in enumerate(C.STAGES):
            df = materialise(stage(spark, df, ""), "test")
            assert k == 4 or df.columns == list(C.COLUMNS)
        assert df.select("doc_id").distinct().count() == n
    # alone, on rows that the stages before would have taken out
    assert C.near_dedup(spark, docs, "").count() == 3
    assert {len(x["text"] or "") for x in C.repeated_text(spark, docs, "").collect()} == {0, 18}
    assert C.mixed(spark, docs, "").where("text is null").count() >= 1 and C.encoded(spark, docs, "").where("doc_id = 2").first()["n_pieces"] == 0
