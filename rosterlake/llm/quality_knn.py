"""Quality classifier by nearest-neighbour voting in a latent semantic space.

Terms are hashed byte trigrams and marks of form (length, share of distinct words, of capitals, of symbols, of repeated
lines, in steps). Document frequencies are counted over all documents. The space is a truncated singular value
decomposition of the tf-idf rows of at most `sample` labelled training documents, those of the least hash (documented
bound). These vectors and labels are what every document meets: exact cosines in blocks, then the `k` nearest vote, each
with its similarity to the power `sharp`, halved towards the share of label 1 by one pseudo-vote.

Empty and null texts are documents without terms: they get the vote of form marks alone. Of equal similarities the
labelled row of smaller id votes first. Repeated rows score alike; with no labelled row every score is 0.5; an empty table gives
an empty result. Of an id's several texts the one of least hash is learned from, and contradicting labels leave the id out. A very
long text is counted whole, in about 60 bytes a byte. Columns of the input are kept, whatever their names; _quality is added or replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm import blocks as B
from rosterlake.llm.keys import Shield, bounded_sample, schema_of
from rosterlake.tables import materialise

GRAMS, FORMS = 1024, 64
TERMS = GRAMS + FORMS
U = np.uint64
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "#*$%&|<>!=~^_{}@"]] = True


def _sums(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flag))[off])


def term_counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts (texts, TERMS)."""
    n = len(off) - 1
    out = np.zeros((n, TERMS), np.float32)
    size = np.diff(off)
    if len(buf) > 2:
        b = buf.astype(np.uint32)
        code = (b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(2654435761) >> np.uint32(22)
        at = B.ranges(off[:-1], size - 2)
        doc = np.repeat(np.arange(n), np.maximum(size - 2, 0))
        out[:, :GRAMS] = np.bincount(doc * GRAMS + code[at], minlength=n * GRAMS).reshape(n, GRAMS)
    start, end, first = B.words(buf, off) if len(buf) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64))
    words = np.diff(first)

    shares = []
    if len(start):
        sums = B.prefix(B.byte_values(buf))
        shares.append(distinct_count(B.span(sums, start, end), first, n) / np.sqrt(np.maximum(words, 1)) / 4)
        breaks = np.flatnonzero(buf == 10)
        cuts = np.unique(np.concatenate([off[:-1][size > 0], breaks + 1, off[1:]]))
        cuts = cuts[cuts <= len(buf)]
        line_a, line_b = cuts[:-1], cuts[1:]
        line_b = np.where(buf[line_b - 1] == 10, line_b - 1, line_b)
        keep = line_b > line_a
        line_a, line_b = line_a[keep], line_b[keep]
        at = np.searchsorted(line_a, off)
        lines = np.diff(at)
        shares.append(1 - distinct_count(B.span(sums, line_a, line_b), at, n) / np.maximum(lines, 1))
    else:
        shares += [np.zeros(n), np.zeros(n)]
    letters = np.maximum(_sums(_ALPHA[buf], off), 1)
    shares += [_sums(_UPPER[buf], off) / letters, np.sqrt(_sums(_MARK[buf], off) / np.maximum(size, 1)), np.log1p(words) / 10]
    weight = np.sqrt(np.maximum(size, 1)).astype(np.float32)
    for k, s in enumerate(shares):
        step = np.minimum((np.clip(s, 0, 0.9999) * 10).astype(int), 9)
        out[np.arange(n), GRAMS + 12 * k + step] = weight
    return out


def distinct_count(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each text has among those between its offsets."""
    doc = np.repeat(np.arange(n), np.diff(at))
    o = np.lexsort((h, doc))
    d, x = doc[o], h[o]
    new = np.ones(len(x), bool)
    new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return np.bincount(d[new], minlength=n)


def _frequencies(batches):
    df, n = np.zeros(TERMS, np.int64), 0
    for rows, buf, off in B.slices(batches, "text"):
        df += (term_counts(buf, off) > 0).sum(0)
        n += len(off) - 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(np.append(df, n))], names=["term", "df"])


def _weighted(logs: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = logs * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def nearest(sim: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row; of equal ones the first."""
    top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    edge = np.take_along_axis(sim, top, 1).min(1)
    for i in np.flatnonzero((sim >= edge[:, None]).sum(1) > k):
        over, equal = np.flatnonzero(sim[i] > edge[i]), np.flatnonzero(sim[i] == edge[i])
        top[i] = np.r_[over, equal[: k - len(over)]]
    return top


class Voter:
    def __init__(self, idf: np.ndarray, logs: np.ndarray, labels: np.ndarray, rank: int = 48, k: int = 15, sharp: float = 4.0):
        self.idf, self.k, self.sharp = idf.astype(np.float32), k, sharp
        x = _weighted(logs, self.idf) if len(logs) else np.zeros((0, TERMS), np.float32)
        if len(x):
            values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
            self.basis = vectors[:, ::-1][:, : min(rank, len(x))].astype(np.float32)
        else:
            self.basis = np.zeros((TERMS, 1), np.float32)
        self.vectors, self.labels = self._latent(x), labels.astype(np.float64)
        self.share = float(labels.mean()) if len(labels) else 0.5

    def _latent(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, buf: np.ndarray, off: np.ndarray, hold: int = 1024) -> np.ndarray:
        n, out = len(off) - 1, np.full(len(off) - 1, 0.5)
        if not len(self.vectors):
            return out
        z = self._latent(_weighted(np.log1p(term_counts(buf, off)), self.idf))
        k = min(self.k, len(self.vectors))
        for i in range(0, n, hold):
            sim = z[i : i + hold] @ self.vectors.T
            top = nearest(sim, k)
            w = np.maximum(np.take_along_axis(sim, top, 1), 0).astype(np.float64) ** self.sharp
            y = self.labels[top]
            out[i : i + hold] = ((w * y).sum(1) + 0.1 * self.share) / (w.sum(1) + 0.1)
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, train_where: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", sample: int = 4000) -> Voter:
    """docs for the frequencies, labels(id, label) for the votes of rows where train_where holds."""
    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = np.zeros(TERMS)
    total = 0
    for r in text.select("text").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # TERMS + 1 rows
        if r["term"] == TERMS:
            total = r["df"]
        else:
            df[r["term"]] = r["df"]
    idf = np.log((1 + total) / (1 + df)) + 0.1
    # labels that contradict each other for one id leave it out
    chosen = labels.where(train_where & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi")).where("lo = hi")
    # only those that have a document count towards the sample
    chosen = materialise(chosen.select("_id", F.col("lo").alias("y")).join(text.select("_id").distinct(), "_id", "left_semi"), "labelled")
    chosen = bounded_sample(chosen, ["_id"], sample, chosen.count())

    def counted(batches):
        for rows, buf, off in B.slices(batches, "text"):
            c = np.log1p(term_counts(buf, off))
            yield pa.RecordBatch.from_arrays([rows.column("_id"), rows.column("_th"), rows.column("y"), pa.array([r.tobytes() for r in c], pa.binary())], names=["_id", "_th", "y", "c"])

    learned = text.join(F.broadcast(chosen), "_id").select("_id", F.xxhash64("text").alias("_th"), F.col("y").cast("int").alias("y"), "text")  # `sample` rows at most
    got = learned.mapInArrow(counted, "_id long, _th long, y int, c binary").groupBy("_id").agg(F.min(F.struct("_th", "y", "c")).alias("r")).select("_id", "r.*").collect()
    got.sort(key=lambda r: r["_id"])
    logs = np.frombuffer(b"".join(r["c"] for r in got), np.float32).reshape(-1, TERMS)
    return Voter(idf, logs, np.array([r["y"] for r in got], float))


def score_quality(docs: DataFrame, voter: Voter, text_col: str = "text") -> DataFrame:
    """docs with _quality instead of the text."""
    shield = Shield(docs, text_col)
    names = [c for c in shield.own if c != "text"]

    def run(batches):
        for rows, buf, off in B.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in names], pa.array(voter.scores(buf, off))], names=[*names, "_quality"])

    schema = [x for x in (schema_of(shield.df, "text"), "_quality double") if x]
    out = shield.df.mapInArrow(run, ", ".join(schema))
    return out.select(*[F.col(c).alias(n) for c, n in zip(shield.own, shield.names) if c != "text" and n != "_quality"], "_quality")
