"""The language field beside a version by definition: no arrays over words, every chain on its own."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import lang_crf
from rosterlake.llm import blocks as B
from rosterlake.llm.queries import op2_lang_crf

MASK = (1 << 64) - 1


def words_of(text: str) -> list[bytes]:
    return [w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", text.encode())]


def slot(value: int, tag: int) -> int:
    return int(B.mix(np.array([(value + tag * 0x9E3779B97F4A7C15) & MASK], np.uint64))[0] >> np.uint64(49))


def features(w: bytes) -> list[int]:
    """Trigrams between the marks 1 and 2, and prefixes and suffixes of one to three bytes, shorter words filled with 0."""
    marked = b"\x01" + w + b"\x02"
    out = [slot(int.from_bytes(marked[i : i + 3], "little"), 1) for i in range(len(w))]
    for k in (1, 2, 3):
        fill = lambda part: int.from_bytes(part + b"\0" * (k - len(part)), "big")
        out += [slot(fill(w[:k]), 2 * k), slot(fill(w[::-1][:k]), 2 * k + 1)]
    return out


def word_key(w: bytes) -> int:
    return int(lang_crf.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])


def posteriors(emit: list[list[float]], trans: list[list[float]]):
    """Label probabilities of each word of a chain, and expected counts of label pairs: by sums over forward and backward products."""
    n, k = len(emit), len(trans)
    e = [[math.exp(max(-40.0, x - max(row))) for x in row] for row in emit]
    f = [[e[0][y] for y in range(k)]]
    for t in range(1, n):
        f.append([sum(f[-1][x] * trans[x][y] for x in range(k)) * e[t][y] for y in range(k)])
        z = sum(f[-1])
        f[-1] = [v / z for v in f[-1]]
    b = [[1.0] * k]
    for t in range(n - 2, -1, -1):
        row = [sum(trans[x][y] * e[t + 1][y] * b[0][y] for y in range(k)) for x in range(k)]
        b.insert(0, [v / sum(row) for v in row])
    post = [[f[t][y] * b[t][y] for y in range(k)] for t in range(n)]
    post = [[v / sum(row) for v in row] for row in post]
    pairs = [[0.0] * k for _ in range(k)]
    for t in range(n - 1):
        cell = [[f[t][x] * trans[x][y] * e[t + 1][y] * b[t + 1][y] for y in range(k)] for x in range(k)]
        z = sum(map(sum, cell))
        for x in range(k):
            for y in range(k):
                pairs[x][y] += cell[x][y] / z
    return post, pairs


class Plain:
    def __init__(self, texts, labels, chain=64, rounds=30, rate=0.25, penalty=1e-4, splice=0.3, seed=3):
        self.chain, self.langs = chain, sorted(set(labels))
        k = len(self.langs)
        freq = Counter(word_key(w) for t in texts for w in words_of(t))
        self.lexicon = {h for h, n in freq.items() if n >= 5}
        self.w = defaultdict(lambda: [0.0] * k)
        self.trans = [[1.0 if x == y else -1.0 for y in range(k)] for x in range(k)]
        chains = []
        for t, lang in zip(texts, labels):
            ws = words_of(t)
            chains += [[(w, self.langs.index(lang)) for w in ws[i : i + chain]] for i in range(0, len(ws), chain)]
        rng = np.random.default_rng(seed)
        other, steps = rng.permutation(len(chains)), max(map(len, chains))
        spliced = (rng.random(len(chains)) < splice).tolist()
        whole = [c for c in chains]
        for i, c in enumerate(chains):
            if spliced[i] and len(c) == len(chains[other[i]]) == steps:
                whole[i] = c[: steps // 2] + chains[other[i]][: steps - steps // 2]
        true = [[sum(a[1] == x and b[1] == y for c in whole for a, b in zip(c, c[1:])) for y in range(k)] for x in range(k)]
        total = sum(map(len, whole))
        m, s = defaultdict(float), defaultdict(float)
        for t in range(1, rounds + 1):
            grad, pairs = defaultdict(float), [[0.0] * k for _ in range(k)]
            for c in whole:
                post, p = posteriors([self.emission(w) for w, _ in c], self.exp())
                for x in range(k):
                    for y in range(k):
                        pairs[x][y] += p[x][y]
                for (w, gold), q in zip(c, post):
                    for y in range(k):
                        d = q[y] - (y == gold)
                        for f in self.keys(w):
                            grad[f, y] += d
            step = lambda g, key: self.move(m, s, key, g, t, rate)
            for (f, y), g in list(grad.items()):
                self.w[f][y] -= step(g / total + penalty * self.w[f][y] * 1e-2, (f, y))
            for x in range(k):
                for y in range(k):
                    self.trans[x][y] -= step((pairs[x][y] - true[x][y]) / total, ("t", x, y))

    @staticmethod
    def move(m, s, key, g, t, rate):
        m[key] = 0.9 * m[key] + 0.1 * g
        s[key] = 0.99 * s[key] + 0.01 * g * g
        return rate * (m[key] / (1 - 0.9**t)) / (math.sqrt(s[key] / (1 - 0.99**t)) + 1e-9)

    def exp(self):
        return [[math.exp(v) for v in row] for row in self.trans]

    def keys(self, w):
        out = [("f", f) for f in features(w)]
        return out + ([("w", word_key(w))] if word_key(w) in self.lexicon else [])

    def emission(self, w):
        rows = [self.w[f] for f in self.keys(w) if f in self.w]
        return [sum(r[y] for r in rows) for y in range(len(self.langs))]

    def label(self, text):
        ws, mass = words_of(text or ""), [0.0] * len(self.langs)
        for i in range(0, len(ws), self.chain):
            post, _ = posteriors([self.emission(w) for w in ws[i : i + self.chain]], self.exp())
            for row in post:
                mass = [a + b for a, b in zip(mass, row)]
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        return self.langs[mass.index(max(mass))], max(mass) / sum(mass)


def corpus(n=45, seed=4):
    r = random.Random(seed)
    words = {"aa": "the and ing tion wor hat".split(), "bb": "der und sch ein ung ist".split(), "cc": "él que ión los ñas por".split()}
    return [(i, " ".join(r.choice(words[lang]) + r.choice(["", "s", "e"]) for _ in range(r.choice([3, 8, 8]))), lang) for i in range(n) for lang in [r.choice("aabc") * 2]]


def test_train_and_label_by_definition():
    rows = corpus()
    fast = lang_crf.train([t for _, t, _ in rows], [lang for *_, lang in rows], chain=8, rounds=12)
    slow = Plain([t for _, t, _ in rows], [lang for *_, lang in rows], chain=8, rounds=12)
    assert np.allclose(fast.trans, slow.trans, atol=1e-7)
    texts = [t for _, t, _ in corpus(30, 9)] + ["the der los the und que tion ung ñas " * 3, "Ærø", "", "12 !"]
    raw = [t.encode() for t in texts]
    langs, score = fast.label(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = [slow.label(t) for t in texts]
    assert langs == [w[0] for w in want] and np.allclose(score, [w[1] for w in want], atol=1e-6)
    assert len(set(langs)) >= 3


def test_query_by_definition(spark, tmp_path):
    """op2 from the table on: who is held out, what is learned from, and the score of every row."""
    import zlib

    rows = [(i, t, lang) for i, t, lang in corpus(60, 5)] + [(100, None, "aa"), (101, "", "bb"), (102, "12", None), (103, "the the und", None)]
    spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in op2_lang_crf(spark, str(tmp_path)).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    order = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "lang", "text"), F.lit(1 << 40)).alias("h")).collect()}
    learn = sorted((r for r in rows if not held(r[0]) and r[1] and r[2]), key=lambda r: order[r[0]])
    slow = Plain([t for _, t, _ in learn], [lang for *_, lang in learn])
    for i, t, _ in rows:
        lang, score = slow.label(t)
        assert got[i][:2] == (held(i), lang) and got[i][2] == pytest.approx(score, abs=1e-6)


def test_repeated_rows_reach_the_driver_once(spark, monkeypatch):
    """A row repeated many times is one of the sample; the rest of the sample is as large as without it."""
    rows = [(i, f"the word number {i}", "aa") for i in range(300)] + [(1000 + i, f"der die das {i}", "bb") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many = df.union(df.where("doc_id = 7").crossJoin(spark.range(20_000)).drop("id").select("doc_id", "text", "lang"))
    seen = []
    monkeypatch.setattr(lang_crf, "train", lambda texts, labels: seen.append(Counter(zip(texts, labels))))
    lang_crf.fit(many, F.lit(True), sample=100, floor=20)
    assert max(seen[0].values()) == 1 and 110 <= len(seen[0]) <= 130 and sum(lang == "bb" for _, lang in seen[0]) == 20
