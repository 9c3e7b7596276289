"""Near-dedup by exact similarity: texts link if the Jaccard similarity of their shingle sets is `least` or more, and a
component is what links reach.

Shingles are those of SimHash (XXH64, seed 42, of words of the lower-cased text), as sets. Equal sets are one class. Two
classes are candidates if they agree in one of 53 bands of 6 MinHash values each, or if their SimHash fingerprints differ
in at most 2 bits; at a similarity of 0.8 a pair misses all bands with a chance of 1e-7, at 0.9 of 1e-17. Candidates are
joined to components, and within each the sets themselves are compared, so no pair below `least` links.

A component of up to `hold` classes is one task's. A larger one is dealt in blocks: its sets are compared with some 16 pivots of
it, which settles a group of near copies in one pass; what does not reach the largest group that the pivots make is then compared
with all, block against block. Blocks answer with spanning links, never with pairs. A class without a candidate ships nothing.

Rows that go, and rows whose sets are asked for, are broadcast only when they have been counted and are `few` at most; so a
text is shuffled only beyond that. Empty sets (null and blank texts) are one class and similar to nothing else; of rows equal in
id and text one stays; a null id is the greatest; an empty table gives an empty result; a very long text takes about 60 bytes
a byte. Columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm import blocks as B
from rosterlake.llm.graph import connected_components
from rosterlake.llm.keys import Shield
from rosterlake.llm.simhash import _LOWER, fingerprints_of, near_links
from rosterlake.tables import materialise

BANDS, ROWS = 53, 6
_FACTOR = (B.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingles_of(buf: np.ndarray, off: np.ndarray, shingle: int, seed: int = 42) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    start, end, first = B.words(buf, off)
    if not len(start):
        return [np.zeros(0, np.uint64)] * (len(off) - 1)
    lens = end - start
    at = np.cumsum(lens + 1) - (lens + 1)
    joined = np.full(int(at[-1] + lens[-1] + 1), 32, np.uint8)
    joined[B.ranges(at, lens)] = _LOWER[buf][B.ranges(start, lens)]
    raw = joined.tobytes()
    count = np.diff(first)
    n = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    i = B.ranges(first[:-1], n)
    last = i + np.minimum(np.repeat(count, n), shingle) - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(raw[a:b], seed) for a, b in zip(at[i].tolist(), (at[last] + lens[last]).tolist())], np.uint64)
    return [np.unique(x) for x in np.split(h, np.cumsum(n)[:-1])]


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """One key a band for each (non-empty) set."""
    h = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    size = np.array([len(x) for x in sets])
    edges = np.cumsum(size) - size
    out = np.zeros((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), b, np.uint64)
        for f in _FACTOR[b * ROWS : (b + 1) * ROWS]:
            key = B.mix(key + np.minimum.reduceat(h * f, edges))
        out[:, b] = key
    return out


def _marked(shingle: int):
    def run(batches):
        for rows, buf, off in B.slices(batches, "text"):
            sets = shingles_of(buf, off, shingle)
            has = [k for k, x in enumerate(sets) if len(x)]
            bands = bands_of([sets[k] for k in has]).ravel() if has else np.zeros(0, np.uint64)
            ends = np.zeros(len(sets) + 1, np.int32)
            ends[1:] = np.cumsum([BANDS * (len(x) > 0) for x in sets])
            yield pa.RecordBatch.from_arrays(
                [rows.column("_id"), rows.column("_th"), _class(sets), B.signed(fingerprints_of(buf, off, shingle)), pa.ListArray.from_arrays(pa.array(ends), B.signed(bands))],
                names=["_id", "_th", "cls", "fp", "bands"],
            )

    return run


def _class(sets: list[np.ndarray]) -> pa.Array:
    return B.signed(np.array([xxhash.xxh64_intdigest(x.tobytes(), 7) for x in sets], np.uint64))


def _sets(shingle: int):
    def run(batches):
        for rows, buf, off in B.slices(batches, "text"):
            sets = shingles_of(buf, off, shingle)
            yield pa.RecordBatch.from_arrays([rows.column("root"), rows.column("cls"), rows.column("k"), pa.array([x.tobytes() for x in sets], pa.binary())], names=["root", "cls", "k", "set"])

    return run


def clusters(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Of each set, a number that all sets it reaches by links share. A set found is not compared again as a target, so a
    group of near copies takes about one comparison each."""
    size = np.array([len(x) for x in sets])
    off = np.cumsum(size) - size
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(known), bool)
    label = np.arange(len(sets))
    left = np.arange(len(sets))
    while len(left):
        head, left = left[0], left[1:]
        queue = [head]
        while queue and len(left):
            d = queue.pop()
            fit = np.minimum(size[left], size[d]) >= least * np.maximum(size[left], size[d]) - 1e-9
            fit &= size[left] > 0
            at = left[fit]
            if not len(at):
                continue
            own = ids[off[d] : off[d] + size[d]]
            mark[own] = True
            both = np.add.reduceat(mark[ids[B.ranges(off[at], size[at])]].astype(np.int64), np.cumsum(size[at]) - size[at])
            mark[own] = False
            hit = at[both * (1 + least) >= least * (size[at] + size[d]) - 1e-9]
            label[hit] = head
            queue += hit.tolist()
            left = left[~np.isin(left, hit)]
    return label


def _verified(least: float):
    """Rows sorted by root -> links (u, v), v the least class of u's verified component."""

    def judge(found: dict[int, bytes]) -> pa.RecordBatch:
        cls = np.array(sorted(found), np.int64)
        label = clusters([np.frombuffer(found[c], np.uint64) for c in cls.tolist()], least)
        far = label != np.arange(len(cls))
        return pa.RecordBatch.from_arrays([pa.array(cls[far]), pa.array(cls[label[far]])], names=["u", "v"])

    def run(batches):
        now, found = None, {}
        for rows in batches:
            for root, cls, data in zip(rows.column("root").to_pylist(), rows.column("cls").to_pylist(), rows.column("set")):
                if root != now and found:
                    yield judge(found)
                    found = {}
                now = root
                if cls not in found:
                    found[cls] = data.as_py()
        if found:
            yield judge(found)

    return run


def spanning(left: list[np.ndarray], right: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what left and right sets reach through each other: (place in left, place in right), at most one for
    each left set and each right set."""
    size = np.array([len(x) for x in left])
    off = np.cumsum(size) - size
    known, ids = np.unique(np.concatenate(left), return_inverse=True)
    label = np.arange(len(left) + len(right))

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    us, vs = [], []
    for j, x in enumerate(right):
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        mark = np.zeros(len(known), bool)
        mark[at[known[at] == x]] = True
        both = np.add.reduceat(mark[ids].astype(np.int64), off)
        for i in np.flatnonzero(both * (1 + least) >= least * (size + len(x)) - 1e-9).tolist():
            a, b = root(i), root(len(left) + j)
            if a != b:
                label[a] = b
                us.append(i)
                vs.append(j)
    return np.array(us, np.int64), np.array(vs, np.int64)


def _meet(least: float):
    """Cogroup of a block of sets and a block of others: links (u, v), and each set that has one."""

    def run(left, right):
        out = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            sets = [[np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()] for t in (left, right)]
            cls = [t.column("cls").to_numpy() for t in (left, right)]
            u, v = spanning(*sets, least)
            out = cls[0][u], cls[1][v]
        return pa.table({"u": out[0], "v": out[1]})

    return run


def _large(sets: DataFrame, least: float, block: int) -> DataFrame:
    """sets(root, cls, set, k: classes of the root) of large components -> links that span what is similar."""
    deal = lambda n: F.pmod(F.xxhash64("cls"), F.ceil(F.col(n) / block)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / block) - 1).cast("int")))
    cast = "u long, v long"
    pivots = sets.where(F.pmod(F.xxhash64(F.lit(3), "cls"), F.col("k")) < 16).select("root", every("k").alias("b"), "cls", "set")
    blocks = sets.select("root", deal("k").alias("b"), "cls", "set")
    first = materialise(blocks.groupBy("root", "b").cogroup(pivots.groupBy("root", "b")).applyInArrow(_meet(least), cast), "pivots")
    # within one group all are linked already; a set of another one may be a link between groups, although it met a pivot
    group = connected_components(first).select(F.col("node").alias("cls"), F.col("root").alias("g"))
    group = materialise(sets.select("root", "cls").join(group, "cls"), "groups")
    most = group.groupBy("root", "g").agg(F.count("*").alias("n")).groupBy("root").agg(F.max_by("g", F.struct("n", "g")).alias("g"))
    rest = sets.join(group.join(most, ["root", "g"]).select("cls"), "cls", "left_anti").select("root", "cls", "set")
    rest = materialise(rest.join(rest.groupBy("root").agg(F.count("*").alias("r")), "root"), "rest")
    if rest.limit(1).count() == 0:
        return first
    other = rest.groupBy("root").agg(F.first("r").alias("r"))
    ask = rest.join(sets.groupBy("root").agg(F.first("k").alias("k")), "root").select("root", every("k").alias("b"), deal("r").alias("c"), "cls", "set")
    whole = sets.join(other, "root").select("root", deal("k").alias("b"), every("r").alias("c"), "cls", "set")
    second = whole.groupBy("root", "b", "c").cogroup(ask.groupBy("root", "b", "c")).applyInArrow(_meet(least), cast)
    return first.union(second)


def _with(texts: DataFrame, rows: DataFrame, how: str, few: int) -> DataFrame:
    """texts joined with rows(_id, _th, ...), a table; it is broadcast if it has at most `few` rows, counted here."""
    return texts.join(F.broadcast(rows) if rows.limit(few + 1).count() <= few else rows, ["_id", "_th"], how)


def near_keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 5, least: float = 0.8, hold: int = 2048, few: int = 500_000) -> DataFrame:
    """docs with one row left of each component: the one of the least id (of equal ids, the least text hash)."""
    shield = Shield(docs, text_col, id_col)
    src = shield.keyed()
    marked = materialise(src.select("_id", "_th", "text").mapInArrow(_marked(shingle), "_id long, _th long, cls long, fp long, bands array<long>"), "marked")
    rep = materialise(marked.groupBy("cls").agg(F.min(F.struct("_id", "_th", "fp", "bands")).alias("r")).select("cls", "r.*"), "classes")
    keys = rep.select("cls", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("key", "lo")
    by_band = keys.join(shared, "key").select(F.col("cls").alias("u"), F.col("lo").alias("v"))
    full = rep.where(F.size("bands") > 0)
    prints = materialise(full.groupBy("fp").agg(F.min("cls").alias("lo")), "prints")
    by_print = full.select("cls", "fp").join(prints, "fp").select(F.col("cls").alias("u"), F.col("lo").alias("v"))
    links = near_links(prints.select("fp")).distinct()
    far = links.join(prints.select(F.col("fp").alias("u"), F.col("lo").alias("a")), "u").join(prints.select(F.col("fp").alias("v"), F.col("lo").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    comps = connected_components(by_band.union(by_print).union(far).where("u <> v"))
    size = comps.groupBy("root").agg(F.count("*").alias("k"))
    asked = materialise(rep.select("_id", "_th", "cls").join(comps, rep.cls == comps.node).join(size, "root").select("_id", "_th", "cls", "root", "k"), "candidates")
    sets = _with(src.select("_id", "_th", "text"), asked, "inner", few).select("root", "cls", "k", "text")
    sets = materialise(sets.mapInArrow(_sets(shingle), "root long, cls long, k long, set binary"), "sets")
    near = sets.where(F.col("k") <= hold).repartition("root").sortWithinPartitions("root").mapInArrow(_verified(least), "u long, v long")
    large = materialise(sets.where(F.col("k") > hold).dropDuplicates(["root", "cls"]), "large")
    if large.limit(1).count():
        near = near.union(_large(large, least, hold))
    real = connected_components(near)
    rows = marked.select("_id", "_th", "cls").join(real, marked.cls == real.node, "left").select("_id", "_th", F.coalesce("root", "cls").alias("g"))
    rows = materialise(rows.groupBy("g", "_id", "_th").agg(F.count("*").alias("n")), "rows")
    stay = rows.groupBy("g").agg(F.min(F.struct("_id", "_th")).alias("r"))
    # rows that go, and rows that occur more than once, of which one comes back
    gone = materialise(rows.join(stay, "g").select("_id", "_th", (F.struct("_id", "_th") == F.col("r")).alias("head"), "n").where("not head or n > 1"), "gone")
    out = _with(src, gone.select("_id", "_th"), "left_anti", few)
    twice = gone.where("head")
    if twice.limit(1).count():
        out = out.union(_with(src, twice.select("_id", "_th"), "left_semi", few).select(*out.columns).dropDuplicates(["_id", "_th"]))
    return shield.restore(out)
