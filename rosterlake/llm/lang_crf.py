"""Language ID by a linear-chain conditional random field over words.

A word is a run of letters (ASCII letters and bytes from 0x80 on). Its emission for each language is a learned sum over
hashed features: prefixes and suffixes of 1 to 3 bytes, all byte trigrams of the word between marks, and its own place in
a lexicon of words frequent in training. Learned transitions join neighbouring words, so a language switch costs; words
are labelled by forward-backward, and a text's language is the one with the most probability over all its words.

A chain is up to `chain` consecutive words of one text; every word of a text is in exactly one chain, so whole texts count.
Training takes about `sample` labelled rows (documented bound), of each language its share or `floor` at least, so that a rare one
is learned too, by full-batch gradient; some of its chains are spliced from two texts, so that transitions see switches. Ties
between languages go to the first in order. Null texts and texts without a letter are `und` with score 0; repeated rows get equal
results; a table without labels, or an empty one, gives `und` for each row. A very long text is labelled whole, in about 60 bytes a
byte. Columns of the input are kept, whatever their names, but for the text; _lang and _lang_score are added or replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.llm import blocks as B
from rosterlake.llm.keys import Shield, schema_of

U = np.uint64
TABLE = 1 << 15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
UND = "und"


def letter_runs(buf: np.ndarray, off: np.ndarray):
    """Like blocks.words, for runs of letters."""
    plain = np.where(_LETTER[buf], _LOWER[buf], np.uint8(32))
    return plain, *B.words(plain, off)


def word_features(plain: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each word, concatenated, and how many each has."""
    size = end - start
    padded = np.zeros(int((size + 2).sum()) + 3, np.uint64)
    at = np.cumsum(size + 2) - (size + 2)
    padded[B.ranges(at + 1, size)] = plain[B.ranges(start, size)]
    padded[at] = 1
    padded[at + 1 + size] = 2
    tri = padded[:-2] | padded[1:-1] << U(8) | padded[2:] << U(16)
    grams = B.ranges(at, size)
    parts = [(tri[grams], size, 1)]
    first, last = at + 1, at + size
    one = np.ones(len(size), np.int64)
    for k in (1, 2, 3):
        pre, suf = np.zeros(len(size), U), np.zeros(len(size), U)
        for j in range(k):
            inside = j < size
            pre = pre << U(8) | np.where(inside, padded[np.minimum(first + j, last)], U(0))
            suf = suf << U(8) | np.where(inside, padded[np.maximum(last - j, first)], U(0))
        parts += [(pre, one, 2 * k), (suf, one, 2 * k + 1)]
    total = np.sum([p[1] for p in parts], axis=0)
    out = np.empty(int(total.sum()), np.int64)
    base = np.cumsum(total) - total
    for values, count, tag in parts:
        out[B.ranges(base, count)] = (B.mix(values + U(tag * 0x9E3779B97F4A7C15 % (1 << 64))) >> U(49)).astype(np.int64)
        base = base + count
    return out, total


def word_hashes(plain: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return B.span(B.prefix(B.byte_values(plain)), start, end)


def chains_of(first: np.ndarray, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the chains of each text's words."""
    n = np.diff(first)
    per = -(-n // chain)
    begin = np.repeat(first[:-1], per) + B.ranges(np.zeros(len(per), np.int64), per) * chain
    return begin, np.minimum(chain, np.repeat(first[1:], per) - begin)


def forward_backward(emit: np.ndarray, length: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """emit (steps, chains, labels), exponentiated; trans exponentiated. Posteriors of the same shape and the summed
    posteriors of label pairs (labels, labels)."""
    steps, n, k = emit.shape
    fwd = np.empty_like(emit)
    back = np.ones_like(emit)
    fwd[0] = emit[0] / emit[0].sum(1, keepdims=True)
    for t in range(1, steps):
        a = (fwd[t - 1] @ trans) * emit[t]
        fwd[t] = a / a.sum(1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        b = (emit[t + 1] * back[t + 1]) @ trans.T
        b /= b.sum(1, keepdims=True)
        back[t] = np.where((t + 1 < length)[:, None], b, 1.0)
    post = fwd * back
    post /= post.sum(2, keepdims=True)
    pairs = np.zeros((k, k))
    for t in range(steps - 1):
        live = t + 1 < length
        left, right = fwd[t][live], (emit[t + 1] * back[t + 1])[live]
        z = np.einsum("ni,ij,nj->n", left, trans, right)
        pairs += (left / z[:, None]).T @ right * trans
    return post, pairs


class Tagger:
    """Weights of a trained field: hashed features, lexicon, transitions."""

    def __init__(self, langs: list[str], lexicon: np.ndarray, chain: int = 64):
        k = len(langs)
        self.langs, self.lexicon, self.chain = langs, lexicon, chain
        self.weights = np.zeros((TABLE, k))
        self.words = np.zeros((len(lexicon) + 1, k))
        self.trans = np.where(np.eye(k, dtype=bool), 1.0, -1.0)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Row of each word in the lexicon; the last row, always zero, for the others."""
        if not len(self.lexicon):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == h, at, len(self.lexicon))

    def emissions(self, feats: np.ndarray, count: np.ndarray, lex: np.ndarray) -> np.ndarray:
        if not len(count):
            return np.zeros((0, len(self.langs)))
        edges = np.cumsum(count) - count
        return np.add.reduceat(self.weights[feats], edges, axis=0) + self.words[lex]

    def _emit(self, scores: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        steps = int(length.max())
        at = begin[None, :] + np.minimum(np.arange(steps)[:, None], length[None, :] - 1)
        e = scores[at]
        return np.exp(np.clip(e - e.max(2, keepdims=True), -40, 0)), at

    def label(self, buf: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
        plain, start, end, first = letter_runs(buf, off)
        n, k = np.diff(first), len(self.langs)
        mass = np.zeros((len(n), k))
        if len(start) and k:
            h = word_hashes(plain, start, end)
            uniq, idx, inverse = np.unique(h, return_index=True, return_inverse=True)
            feats, count = word_features(plain, start[idx], end[idx])
            scores = self.emissions(feats, count, self.lookup(uniq))[inverse]
            begin, length = chains_of(first, self.chain)
            doc = np.searchsorted(first, begin, "right") - 1
            trans = np.exp(self.trans)
            for i in range(0, len(begin), 2048):
                b, m = begin[i : i + 2048], length[i : i + 2048]
                emit, _ = self._emit(scores, b, m)
                post = forward_only(emit, m, trans)
                live = np.arange(len(post))[:, None] < m[None, :]
                np.add.at(mass, doc[i : i + 2048], (post * live[:, :, None]).sum(0))
        best = mass.argmax(1) if k else np.zeros(len(n), int)
        total = mass.sum(1)
        score = np.where(total > 0, mass.max(1, initial=0) / np.maximum(total, 1e-300), 0.0)
        langs = []
        for i, b in enumerate(best):
            part = buf[off[i] : off[i + 1]]
            letters = n[i] and k and (((part >= 65) & (part <= 90)) | ((part >= 97) & (part <= 122))).any()
            if n[i] and k and not letters:
                letters = any(c.isalpha() for c in part.tobytes().decode("utf-8", "ignore"))
            langs.append(self.langs[b] if letters else UND)
            if not letters:
                score[i] = 0.0
        return langs, np.clip(score, 0.0, 1.0)


def forward_only(emit: np.ndarray, length: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Posteriors without the sums over pairs."""
    steps = len(emit)
    fwd = np.empty_like(emit)
    fwd[0] = emit[0]
    for t in range(1, steps):
        a = (fwd[t - 1] @ trans) * emit[t]
        fwd[t] = a / a.sum(1, keepdims=True)
    back = np.ones_like(emit[0])
    for t in range(steps - 1, -1, -1):
        if t < steps - 1:
            b = (emit[t + 1] * back) @ trans.T
            back = np.where((t + 1 < length)[:, None], b / b.sum(1, keepdims=True), 1.0)
        fwd[t] *= back
        fwd[t] /= fwd[t].sum(1, keepdims=True)
    return fwd


def train(texts: list[str], labels: list[str], chain: int = 64, rounds: int = 30, rate: float = 0.25, penalty: float = 1e-4, lexicon: int = 20_000, splice: float = 0.3, seed: int = 3) -> Tagger:
    langs = sorted(set(labels))
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    plain, start, end, first = letter_runs(np.frombuffer(b"".join(raw), np.uint8), off)
    if not len(start) or len(langs) < 2:
        return Tagger(langs, np.zeros(0, U), chain)
    h = word_hashes(plain, start, end)
    uniq, idx, inverse, freq = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    often = uniq[np.sort(np.argsort(-freq, kind="stable")[:lexicon])]
    tagger = Tagger(langs, often[np.isin(often, uniq[freq >= 5])], chain)
    feats, count = word_features(plain, start[idx], end[idx])
    lex = tagger.lookup(uniq)
    gold = np.repeat(np.searchsorted(langs, labels), np.diff(first))
    begin, length = chains_of(first, chain)
    rng = np.random.default_rng(seed)
    k, k0 = len(langs), len(begin)
    # word places of each chain; a spliced one takes its second half from another chain
    steps = int(length.max())
    at = begin[:, None] + np.minimum(np.arange(steps)[None, :], length[:, None] - 1)
    other = rng.permutation(k0)
    mixed = np.flatnonzero((rng.random(k0) < splice) & (length == steps) & (length[other] == steps))
    at[mixed, steps // 2 :] = at[other[mixed], : steps - steps // 2]
    word, y = inverse[at].T, gold[at].T
    live = np.arange(steps)[:, None] < length[None, :]
    true_pairs = np.zeros((k, k))
    np.add.at(true_pairs, (y[:-1][live[1:]], y[1:][live[1:]]), 1.0)
    total = live.sum()
    params = [tagger.weights, tagger.words, tagger.trans]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    owner = np.repeat(np.arange(len(uniq)), count)
    for t in range(1, rounds + 1):
        scores = tagger.emissions(feats, count, lex)
        grad_word, pairs = np.zeros((len(uniq), k)), np.zeros((k, k))
        for i in range(0, k0, 2048):
            w, e = word[:, i : i + 2048], scores[word[:, i : i + 2048]]
            post, p = forward_backward(np.exp(np.clip(e - e.max(2, keepdims=True), -40, 0)), length[i : i + 2048], np.exp(tagger.trans))
            pairs += p
            post -= np.eye(k)[y[:, i : i + 2048]]
            post *= live[:, i : i + 2048, None]
            for c in range(k):
                grad_word[:, c] += np.bincount(w.ravel(), post[:, :, c].ravel(), len(uniq))
        g_feat = np.stack([np.bincount(feats, grad_word[owner, c], TABLE) for c in range(k)], 1)
        g_lex = np.stack([np.bincount(lex, grad_word[:, c], len(tagger.words)) for c in range(k)], 1)
        g_lex[-1] = 0
        for j, g in enumerate((g_feat, g_lex, pairs - true_pairs)):
            g = g / total + penalty * params[j] * (j < 2) * 1e-2
            m[j] = 0.9 * m[j] + 0.1 * g
            s[j] = 0.99 * s[j] + 0.01 * g * g
            params[j] -= rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(s[j] / (1 - 0.99**t)) + 1e-9)
    tagger.words[-1] = 0
    return tagger


def fit(docs: DataFrame, train_where: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = 1200, floor: int = 40, longest: int = 100_000) -> Tagger:
    """Trains on about `sample` rows with text and language where train_where holds: of each language its share of them, but
    `floor` at least, those of the least hash. Texts of over `longest` characters aren't learned from (they are labelled like any
    other), and repeated rows are learned from once, so what reaches the driver is bounded in rows and bytes whatever the table holds. Languages are
    collected with about how many different rows they have: they are few by nature."""
    size = F.length(text_col)
    rows = docs.where(train_where & F.col(lang_col).isNotNull() & size.between(1, longest)).select(F.col(id_col).cast("string").alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("i", "l", "t"), F.lit(1 << 40)))
    count = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not count:
        return train([], [])
    quota = {k: max(floor, -(-sample * n // sum(count.values()))) for k, n in count.items()}
    per = lambda value: F.element_at(F.create_map(*[F.lit(x) for k in count for x in (k, value(k))]), F.col("l"))
    # twice the quota's share of the hashes, repeated rows once; then the quota itself, cut in each task before they meet
    some = rows.where(F.col("h") < per(lambda k: float(2 * quota[k] / count[k])) * F.lit(float(1 << 40))).dropDuplicates(["i", "l", "t"])
    place = F.row_number().over(Window.partitionBy("l").orderBy("h", F.col("i").asc_nulls_first(), "t"))
    least = some.withColumn("place", place).where(F.col("place") <= max(quota.values())).where(F.col("place") <= per(lambda k: quota[k]))
    chosen = sorted(least.collect(), key=lambda r: (r["h"], r["i"] or "", r["l"], r["t"]))
    return train([r["t"] for r in chosen], [r["l"] for r in chosen])


def identify(docs: DataFrame, tagger: Tagger, text_col: str = "text") -> DataFrame:
    """docs with _lang and _lang_score instead of the text."""
    shield = Shield(docs, text_col)
    names = [c for c in shield.own if c != "text"]

    def run(batches):
        for rows, buf, off in B.slices(batches, "text"):
            langs, score = tagger.label(buf, off)
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in names], pa.array(langs, pa.string()), pa.array(score)], names=[*names, "_lang", "_lang_score"])

    schema = [x for x in (schema_of(shield.df, "text"), "_lang string, _lang_score double") if x]
    out = shield.df.mapInArrow(run, ", ".join(schema))
    return out.select(*[F.col(c).alias(n) for c, n in zip(shield.own, shield.names) if c != "text" and n not in ("_lang", "_lang_score")], "_lang", "_lang_score")
