from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterlake.llm import lang_crf, quality_knn
from rosterlake.llm import piece_dropout as P
from rosterlake.llm.lang_crf import forward_backward, forward_only
from tests.llm.test_dedup import empty, odd, odd_rows  # noqa: F401

M = P.load()


def pack(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=6), st.sampled_from([0.0, 0.2, 1.0]))
def test_round_trip(texts, dropout):
    ids, at = P.encode_slice(M, *pack(texts), np.arange(len(texts)), dropout, 1)
    out, off = P.decode_slice(M, ids.astype(np.int64), at)
    assert [out[a:b].tobytes().decode() for a, b in zip(off, off[1:])] == texts


def test_plain_is_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    texts = [t for _, t in odd_rows() if t] + ["  Hello  wörld\n\tx 日本語 ", "the " * 200, "antidisestablishmentarianism" * 9]
    ids, at = P.encode_slice(M, *pack(texts), np.zeros(len(texts), int), 0.0, 1)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [sp.encode(t) for t in texts]


def test_long_and_short_units_agree():
    r = random.Random(2)
    for _ in range(40):
        word = "".join(r.choice("theandingstion") for _ in range(r.randint(2, 40)))
        code = [M.char_piece[np.searchsorted(M.chars, ord(c))] for c in word]
        salt = np.array([r.getrandbits(63)], np.uint64)
        out, n = P.merge_rows(M, np.array([code], np.int64), np.array([len(code)]), salt, 0.3)
        assert out[0, : n[0]].tolist() == P.merge_long(M, np.array(code), int(salt[0]), 0.3).tolist()


def _plain_unit(symbols, salt, dropout):
    """The agenda by definition: each neighbouring pair is looked at once, when it comes to be; the best join goes first."""
    table = {int(k): (int(r), int(p)) for k, r, p in zip(M.join_keys, M.join_rank, M.join_piece)}
    items = [(s, i) for i, s in enumerate(symbols)]
    judged = {}

    def allowed(k):
        (x, at), (y, to) = items[k], items[k + 1]
        if (x, at, y, to) not in judged:
            key = x << 32 | y
            h = P._mix1(salt ^ P._mix1(key + at * 0x9E3779B97F4A7C15 & P._MASK))
            judged[x, at, y, to] = table.get(key) if dropout == 0 or (h >> 11) * 2.0**-53 >= dropout else None
        return judged[x, at, y, to]

    while True:
        found = [(allowed(k)[0], k) for k in range(len(items) - 1) if allowed(k)]
        if not found:
            return [s for s, _ in items]
        k = min(found)[1]
        items[k : k + 2] = [(allowed(k)[1], items[k][1])]


def test_dropout_is_the_agenda_by_definition():
    """Whole texts with dropout beside a plain version that knows no arrays, heaps or shared units."""
    r = random.Random(12)
    texts = [" ".join("".join(r.choice("theandingsrom") for _ in range(r.randint(1, 9))) for _ in range(30)) for _ in range(4)] + ["x" * 70 + "日本" * 40, "a\n b", "The  end"]
    for dropout in (0.1, 0.6):
        ids, at = P.encode_slice(M, *pack(texts), np.arange(len(texts)) % 3, dropout, 5)
        for i, t in enumerate(texts):
            buf = np.frombuffer((" " + t).encode(), np.uint8)
            units = [m.group().encode() for m in re.finditer(r"[\x09-\x0d]| *[^ \x09-\x0d]+| +", " " + t)]
            want = []
            for u in units:
                code = [0x2581 if c == " " else ord(c) for c in u.decode()]
                cut = [0, *[k for k in range(1, len(code)) if len(code) > P.SHORT and code[k - 1] << 32 | code[k] not in set(M.pairs.tolist())], len(code)]
                for x, y in zip(cut, cut[1:]):
                    raw = u.decode()[x:y].encode()
                    h = P.B.span(P.B.prefix(P.B.byte_values(np.frombuffer(raw, np.uint8))), np.array([0]), np.array([len(raw)]))
                    base = P.B.mix(np.array([i % 3], np.uint64) + np.uint64(5 * 0xD1B54A32D192ED03 % (1 << 64)))
                    salt = int(P.B.mix(h ^ base)[0])
                    known = dict(zip(M.chars.tolist(), M.char_piece.tolist()))
                    for s in _plain_unit([known.get(c, M.size + c) for c in code[x:y]], salt, dropout):
                        want += [int(M.byte_piece[v]) for v in chr(s - M.size).encode()] if s >= M.size else [s]
            assert ids[at[i] : at[i + 1]].tolist() == want, t
            assert len(buf)


def test_units_of_equal_hash_are_told_apart():
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    texts = ["".join("ab"[b] for b in bits) + " ", "".join("ba"[b] for b in bits) + " "] * 2
    ids, at = P.encode_slice(M, *pack(texts), np.zeros(4, int), 0.1, 1)
    out, off = P.decode_slice(M, ids.astype(np.int64), at)
    assert [out[a:b].tobytes().decode() for a, b in zip(off, off[1:])] == texts


def test_text_without_spaces_is_quick():
    import base64
    import time

    texts = ["漢字かな交じり文" * 12_000, base64.b64encode(random.Random(1).randbytes(75_000)).decode()]
    began = time.time()
    ids, at = P.encode_slice(M, *pack(texts), np.zeros(2, int), 0.1, 1)
    assert time.time() - began < 10
    out, off = P.decode_slice(M, ids.astype(np.int64), at)
    assert [out[a:b].tobytes().decode() for a, b in zip(off, off[1:])] == texts


def test_dropout_is_keyed():
    text = ["the international organization for standardization"] * 3
    ids, at = P.encode_slice(M, *pack(text), np.array([1, 1, 2]), 0.4, 9)
    a, b, c = (ids[x:y].tolist() for x, y in zip(at, at[1:]))
    assert a == b and a != c


def test_encode_frames(odd):
    rows, df = odd
    out = P.decode(P.encode(df.drop("_kept")))
    got = sorted(((r["doc_id"], r["_decoded"]) for r in out.collect()), key=str)
    assert got == sorted(((i, t or "") for i, t in rows), key=str)
    assert P.encode(empty(df)).count() == 0


def test_forward_backward_is_exact():
    r = np.random.default_rng(0)
    steps, k = 5, 3
    emit, trans = r.random((steps, 2, k)) + 0.1, r.random((k, k)) + 0.1
    length = np.array([5, 3])
    post, pairs = forward_backward(emit, length, trans)
    assert np.allclose(forward_only(emit, length, trans)[:3, 1], post[:3, 1]) and np.allclose(forward_only(emit, length, trans)[:, 0], post[:, 0])
    want, want_pairs = np.zeros_like(post), np.zeros((k, k))
    for c in range(2):
        paths = np.indices((k,) * length[c]).reshape(length[c], -1).T
        weight = np.array([np.prod([emit[t, c, p[t]] for t in range(len(p))]) * np.prod([trans[a, b] for a, b in zip(p, p[1:])]) for p in paths])
        weight /= weight.sum()
        for p, w in zip(paths, weight):
            for t, s in enumerate(p):
                want[t, c, s] += w
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += w
    assert np.allclose(post[:, 0], want[:, 0]) and np.allclose(post[:3, 1], want[:3, 1]) and np.allclose(pairs, want_pairs)


def test_code_switched_words():
    r = random.Random(1)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(80))
    texts, langs = [], []
    for _ in range(40):
        texts += [make("abcdef"), make("uvwxyz")]
        langs += ["aa", "zz"]
    tagger = lang_crf.train(texts, langs, rounds=15)
    got, score = tagger.label(*pack([make("abcdef"), make("uvwxyz"), make("abcdef") + " " + make("uvwxyz"), "", "123 !?", "…", "é"]))
    assert got[:2] == ["aa", "zz"] and got[3:6] == ["und"] * 3 and got[6] in ("aa", "zz")
    assert score[0] > 0.95 and 0.4 < score[2] < 0.6 and score[3] == 0


def test_language_frames(odd, spark):
    rows, df = odd
    tagger = lang_crf.train(["aaa bbb ccc"] * 4 + ["xxx yyy zzz"] * 4, ["aa"] * 4 + ["zz"] * 4, rounds=3)
    out = lang_crf.identify(df.withColumn("_lang", F.lit(1)), tagger).collect()
    assert len(out) == len(rows) and {r["_lang"] for r in out if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert lang_crf.identify(empty(df), tagger).count() == 0
    none = lang_crf.fit(spark.createDataFrame([], "doc_id long, text string, lang string"), F.lit(True))
    assert {r["_lang"] for r in lang_crf.identify(df, none).collect()} == {"und"}


@pytest.mark.parametrize("name,label,held,least", [("lang", "lang", (4, 2), 0.97), ("quality", "quality", (3, 1), 0.93)])
def test_held_out_accuracy(spark, sf, name, label, held, least):
    from rosterlake.llm import queries as Q

    out = (Q.op2_lang_crf if name == "lang" else Q.op10_quality_knn)(spark, sf)
    table = "documents" if name == "lang" else "labels"
    truth = spark.read.parquet(f"{sf}/{table}.parquet").select("doc_id", label)
    j = out.join(truth, "doc_id").where(f"held_out and {label} is not null")
    pred = "lang_pred" if name == "lang" else "predicted"
    hit, n = j.where(F.col(pred) == F.col(label)).count(), j.count()
    assert n > 10 and hit / n >= least
    assert out.where(f"held_out <> (crc32(cast(doc_id as string)) % {held[0]} = {held[1]})").count() == 0


def test_quality_frames(odd, spark):
    rows, df = odd
    labels = spark.createDataFrame([(1, 1), (11, 1), (9, 0), (13, 0), (9, 0), (12, 0), (12, 1), (None, 1)], "doc_id long, quality int")
    voter = quality_knn.fit(df, labels, F.lit(True))
    assert len(voter.labels) == 4
    out = quality_knn.score_quality(df, voter).collect()
    assert len(out) == len(rows) and all(0 <= r["_quality"] <= 1 for r in out)
    assert quality_knn.score_quality(empty(df), voter).count() == 0
    none = quality_knn.fit(df, labels.where("false"), F.lit(True))
    assert {r["_quality"] for r in quality_knn.score_quality(df, none).collect()} == {0.5}


def test_a_term_many_times_over(spark):
    """One labelled text with a trigram 100,000 times: no score leaves 0 to 1, and its own vector scores as it was learned."""
    rows = [(k, " ".join(f"w{k * j % 97}" for j in range(60))) for k in range(40)] + [(100, "aaa" * 33_400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    voter = quality_knn.fit(docs, spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int"), F.lit(True))
    assert np.isfinite(voter.vectors).all()
    got = {r["doc_id"]: r["_quality"] for r in quality_knn.score_quality(docs, voter).collect()}
    assert len(got) == 41 and all(0 <= s <= 1 for s in got.values())
    z = voter._latent(quality_knn._weighted(np.log1p(quality_knn.term_counts(*pack([rows[-1][1]]))), voter.idf))
    assert np.abs(z - voter.vectors[-1]).max() < 1e-5


def test_ties_go_to_the_smaller_id():
    sim = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2, 0.2], [5, 4, 3, 2, 1]], np.float32)
    assert [sorted(x) for x in quality_knn.nearest(sim, 2).tolist()] == [[0, 1], [0, 1], [0, 1]]


def test_quality_end_to_end_by_definition(spark):
    """Features, space and votes of whole tables beside a version without blocks and batches."""
    r = random.Random(6)
    rows = [(k, " ".join("".join(r.choice("abcde#A") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 40)))) for k in range(80)]
    labels = [(k, int(rows[k][1].count("#") > 9)) for k in range(0, 80, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    voter = quality_knn.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.col("doc_id") % 4 == 0)
    got = {x["doc_id"]: x["_quality"] for x in quality_knn.score_quality(docs, voter).collect()}
    counts = np.concatenate([quality_knn.term_counts(*pack([t])) for _, t in rows])
    for k, (_, t) in enumerate(rows):  # the trigram part by definition
        raw, want = t.encode(), np.zeros(quality_knn.GRAMS)
        for i in range(len(raw) - 2):
            want[((raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) * 2654435761 % (1 << 32)) >> 22] += 1
        assert (counts[k, : quality_knn.GRAMS] == want).all()
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(0))) + 0.1
    x = np.log1p(counts) * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    own = [k for k, _ in labels if k % 4 == 0]
    y = np.array([dict(labels)[k] for k in own], float)
    z = x @ np.linalg.svd(x[own], full_matrices=False)[2][: min(48, len(own))].T
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    for k in range(len(rows)):
        sim = z[own] @ z[k]
        top = np.argsort(-sim, kind="stable")[:15]
        w = np.maximum(sim[top], 0) ** 4
        assert abs(got[k] - ((w * y[top]).sum() + 0.1 * y.mean()) / (w.sum() + 0.1)) < 1e-2  # its space is in single precision


def test_votes_are_the_nearest():
    r = np.random.default_rng(3)
    texts = ["".join(r.choice(list("abcd \n*"), 200)) for _ in range(60)]
    counts = np.log1p(quality_knn.term_counts(*pack(texts)))
    y = r.integers(0, 2, 40)
    voter = quality_knn.Voter(np.ones(quality_knn.TERMS), counts[:40], y, rank=20, k=5)
    got = voter.scores(*pack(texts[40:]), hold=7)
    z = voter._latent(quality_knn._weighted(counts[40:], voter.idf))
    for row, s in zip(z, got):
        sim = voter.vectors @ row
        top = np.argsort(-sim)[:5]
        w = np.maximum(sim[top], 0) ** 4
        assert abs(s - ((w * y[top]).sum() + 0.1 * y.mean()) / (w.sum() + 0.1)) < 1e-4


def test_each_document_can_have_its_own_segmentations(spark):
    """A text under many ids is cut in many ways, under one id in one, and all decode to it; a number of variants bounds the ways."""
    text = "internationalization considerations notwithstanding uncharacteristically"
    df = spark.createDataFrame([(i % 40, text) for i in range(80)], "doc_id long, text string")
    rows = P.decode(P.encode(df, dropout=0.3, variants=None)).collect()
    ways = {}
    for r in rows:
        ways.setdefault(r["doc_id"], set()).add(tuple(r["_pieces"]))
    assert all(len(w) == 1 for w in ways.values()) and len(set().union(*ways.values())) > 30 and {r["_decoded"] for r in rows} == {text}
    assert 1 < len({tuple(r["_pieces"]) for r in P.encode(df, dropout=0.3).collect()}) <= 8
