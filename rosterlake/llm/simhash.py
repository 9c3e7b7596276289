"""SimHash near-dedup by a generalised pigeonhole.

Fingerprints: 64 bits, the majority over XXH64 (seed 42) of the 3-word shingles of the lower-cased (A-Z) text, repeats
included. Two texts link if their fingerprints differ in at most `distance` bits, and a component is what links reach.

Only distinct fingerprints are compared. Bits are grouped by their correlation over all fingerprints into parts of
unequal spread; each part i gets a threshold T_i, -1 (unused) to distance, with sum(T) = distance - parts + 1: of any two
fingerprints within distance, some part differs in at most T_i bits. Dynamic programming picks the thresholds (and the
number of parts) with the fewest probes and candidates as estimated from the bit counts of all fingerprints. Each
fingerprint is indexed under the value of each used part and probes all values within T_i; meetings are verified on
all 64 bits. A bucket of more than `hot` rows is dealt again by three parts of its other bits, which loses no link for
distance 2 (in general distance + 1 parts), and again as long as it is hot: each time its rows agree in more bits, and with
FREE bits left there are few different ones. Buckets answer with spanning links only, so no bucket emits its pairs.

Null and blank texts have fingerprint zero and link like any other; fewer words than a shingle are one shingle; repeated
rows share a fingerprint, and ties don't arise, as the least id counts; a null id counts as the greatest; an empty table gives an
empty result. A very long text takes about 60 bytes a byte. Only the id and the text are read, whatever other columns are named.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm import blocks as B
from rosterlake.llm.graph import connected_components
from rosterlake.llm.keys import LAST, Shield
from rosterlake.tables import materialise

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PROBE_COST = 4.0
FREE = 12
#: Hot buckets that are broadcast at most; they are counted.
HOT_KEYS = 100_000


def fingerprints_of(buf: np.ndarray, off: np.ndarray, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Fingerprints (uint64) of the texts in buf."""
    start, end, first = B.words(buf, off)
    n_docs = len(off) - 1
    out = np.zeros(n_docs, np.uint64)
    if not len(start):
        return out
    low = _LOWER[buf]
    lens = end - start
    at = np.cumsum(lens + 1) - (lens + 1)  # starts of the words, one space after each
    joined = np.full(int(at[-1] + lens[-1] + 1), 32, np.uint8)
    joined[B.ranges(at, lens)] = low[B.ranges(start, lens)]
    raw = joined.tobytes()
    count = np.diff(first)
    n = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    i = B.ranges(first[:-1], n)
    last = i + np.minimum(np.repeat(count, n), shingle) - 1
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(raw[a:b], seed) for a, b in zip(at[i].tolist(), (at[last] + lens[last]).tolist())], np.uint64)
    has = np.flatnonzero(n)
    edges = np.cumsum(n[has]) - n[has]
    bits = np.zeros(len(has), np.uint64)
    for k in range(64):
        set_ = np.add.reduceat((h >> np.uint64(k)) & np.uint64(1), edges)
        bits |= (2 * set_ > n[has].astype(np.uint64)).astype(np.uint64) << np.uint64(k)
    out[has] = bits
    return out


def _fingerprint(shingle: int, seed: int):
    def run(batches):
        for rows, buf, off in B.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column("_id"), rows.column("_th"), B.signed(fingerprints_of(buf, off, shingle, seed))], names=["_id", "_th", "fp"])

    return run


def _bits(x: np.ndarray) -> np.ndarray:
    return ((x[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)


def _counted(batches):
    total = np.zeros((64, 64))
    n = 0
    for rows in batches:
        x = rows.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(x), 50_000):
            b = _bits(x[i : i + 50_000])
            total += b.T @ b
        n += len(x)
    if n:
        i, j = np.indices((64, 64))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel().astype(np.int64)), pa.array(np.full(4096, n))], names=["i", "j", "c", "n"])


def group_bits(both: np.ndarray, n: float, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of at most ceil(64 / parts), the most correlated pairs together first."""
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / n - np.outer(p, p)) / np.outer(sd, sd)
    room = -(-64 // parts)
    groups: list[list[int]] = []
    left = set(range(64))
    while left:
        seed = max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))
        left.discard(seed)
        group = [seed]
        while left and len(group) < min(room, -(-(len(left) + len(group)) // max(1, parts - len(groups)))):
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            left.discard(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def allocate(groups: list[list[int]], p: np.ndarray, n: float, distance: int) -> tuple[float, list[int]]:
    """Least estimated cost a fingerprint and the thresholds that have it, by dynamic programming over the parts."""
    m, target = len(groups), distance - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g in groups:
        differ = np.zeros(distance + 1)
        differ[0] = 1.0
        for b in g:
            q = 2 * p[b] * (1 - p[b])
            differ = differ * (1 - q) + np.append(0, differ[:-1]) * q
        cost, ball, step = {-1: 0.0}, 0, 1
        for t in range(distance + 1):
            ball += step
            step = step * (len(g) - t) // (t + 1)
            cost[t] = PROBE_COST * ball + n * differ[: t + 1].sum()
        new: dict[int, tuple[float, list[int]]] = {}
        for done, (c, ts) in best.items():
            for t, extra in cost.items():
                if done + t not in new or c + extra < new[done + t][0]:
                    new[done + t] = (c + extra, [*ts, t])
        best = new
    assert m
    return best[target]


def pick(values: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for k, b in enumerate(bits):
        out |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _ball(width: int, t: int) -> list[int]:
    masks, layer = [0], {0}
    for _ in range(t):
        layer = {m | 1 << b for m in layer for b in range(width) if not m >> b & 1}
        masks += sorted(layer)
    return masks


def _probe(plan: list[tuple[list[int], int]]):
    """kind 1: in the index, 2: probing, 3: both."""

    def run(batches):
        for rows in batches:
            col = rows.column("fp")
            x = col.to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (bits, t) in enumerate(plan):
                v = pick(x, bits)
                tag = np.uint64(i) << np.uint64(58)
                for mask in _ball(len(bits), t):
                    key = (v ^ np.uint64(mask)) | tag
                    kind = 3 if t == 0 else 1 if mask == 0 else 2
                    yield pa.RecordBatch.from_arrays([B.signed(key), pa.array(np.full(len(x), 3 if mask == 0 else kind, np.int8)), col], names=["key", "kind", "fp"])

    return run


def _deal(distance: int):
    """Rows of hot buckets, dealt by distance + 1 parts of the bits in which a bucket may still differ (those not in mask)."""

    def run(batches):
        for rows in batches:
            x, key, mask = (rows.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("fp", "key", "mask"))
            for m in np.unique(mask):
                own = np.flatnonzero(mask == m)
                free = [b for b in range(64) if not int(m) >> b & 1]
                for j, bits in enumerate(np.array_split(free, distance + 1)):
                    more = np.uint64(sum(1 << int(b) for b in bits))
                    to = B.mix(key[own] ^ B.mix(x[own] & more) ^ np.uint64(j + 1))
                    yield pa.RecordBatch.from_arrays([B.signed(to), B.signed(np.full(len(own), m | more)), B.signed(x[own])], names=["key", "mask", "fp"])

    return run


def _star(x: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (each to the least of its cluster) of one bucket."""
    x = np.unique(x)
    label = np.arange(len(x))
    if len(x) <= 2048:
        pairs = [np.nonzero(np.bitwise_count(x[i : i + 512, None] ^ x[None, :]) <= distance) for i in range(0, len(x), 512)]
        u = np.concatenate([a + i * 512 for i, (a, _) in enumerate(pairs)])
        v = np.concatenate([b for _, b in pairs])
    else:
        us, vs = [], []
        for mask in _ball(64, distance):
            y = x ^ np.uint64(mask)
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            hit = np.flatnonzero(x[at] == y)
            us.append(hit)
            vs.append(at[hit])
        u, v = np.concatenate(us), np.concatenate(vs)
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(x)))
    return x[far], x[label[far]]


def _verify(distance: int, small: int = 16):
    def link(key, x):
        new = np.ones(len(x), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(x)))
        group = np.repeat(np.arange(len(first)), size)
        us, vs = [], []
        for k in range(1, min(small, int(size.max(initial=0)))):
            near = (group[k:] == group[:-k]) & (size[group[k:]] <= small) & (np.bitwise_count(x[k:] ^ x[:-k]) <= distance) & (x[k:] != x[:-k])
            i = np.flatnonzero(near)
            us.append(x[i])
            vs.append(x[i + k])
        for g in np.flatnonzero(size > small):
            u, v = _star(x[first[g] : first[g] + size[g]], distance)
            us.append(u)
            vs.append(v)
        none = np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([B.signed(np.concatenate([none, *us])), B.signed(np.concatenate([none, *vs]))], names=["u", "v"])

    def run(batches):
        held = None
        for rows in batches:
            if not rows.num_rows:
                continue
            got = [rows.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp")]
            got = [np.concatenate([a, b]) for a, b in zip(held, got)] if held is not None else got
            cut = int(np.flatnonzero(got[0] == got[0][-1])[0])
            held = [a[cut:].copy() for a in got]
            if cut:
                yield link(got[0][:cut], got[1][:cut].view(np.uint64))
        if held is not None:
            yield link(held[0], held[1].view(np.uint64))

    return run


def near_links(distinct: DataFrame, distance: int = 2, hot: int = 20_000) -> DataFrame:
    """distinct(fp long, no repeats) -> links (u, v) that span every cluster of fingerprints within distance."""
    spark = distinct.sparkSession
    stats = distinct.select("fp").mapInArrow(_counted, "i int, j int, c long, n long").groupBy("i", "j").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()
    if not stats:
        return spark.createDataFrame([], "u long, v long")
    both, n = np.zeros((64, 64)), float(stats[0]["n"])
    for r in stats:
        both[r["i"], r["j"]] = r["c"]
    plans = []
    for parts in range(max(1, distance), distance + 3):
        groups = group_bits(both, n, parts)
        cost, ts = allocate(groups, np.diag(both) / n, n, distance)
        plans.append((cost, [(g, t) for g, t in zip(groups, ts) if t >= 0]))
    plan = min(plans, key=lambda x: x[0])[1]
    meet = materialise(distinct.select("fp").mapInArrow(_probe(plan), "key long, kind byte, fp long"), "probes").select("key", "fp")
    masks = F.array(*[F.lit(_as_long(sum(1 << b for b in bits))) for bits, _ in plan])
    level = meet.withColumn("mask", F.element_at(masks, F.shiftrightunsigned("key", 58).cast("int") + 1))
    done = []
    while True:
        size = level.groupBy("key", "mask").agg(F.count("*").alias("size")).where("size > 1")
        over = (F.col("size") > hot) & (F.lit(64) - F.bit_count("mask") > FREE)
        large = materialise(size.where(over).select("key"), "hot")
        n = large.limit(HOT_KEYS + 1).count()
        keys = F.broadcast(large) if n <= HOT_KEYS else large
        rest = level.join(keys, "key", "left_anti") if n else level
        done.append(rest.join(size.where(~over).select("key"), "key", "left_semi").select("key", "fp"))
        if not n:
            break
        level = materialise(level.join(keys, "key", "left_semi").mapInArrow(_deal(distance), "key long, mask long, fp long"), "dealt")
    return reduce(DataFrame.union, done).repartition("key").sortWithinPartitions("key").mapInArrow(_verify(distance), "u long, v long")


def _as_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """One row per row of docs: the id, _id and _th (its row key), _fp (long, the fingerprint's bits), _root (the
    component's least fingerprint), _component (the least id reachable, itself included; null if all ids there are null)."""
    src = Shield(docs.select(id_col, text_col), text_col, id_col).keyed().select("_id", "_th", "text")
    marked = materialise(src.mapInArrow(_fingerprint(shingle, seed), "_id long, _th long, fp long"), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min("_id").alias("lo")), "distinct")
    links = near_links(distinct, distance)
    comps = materialise(connected_components(links), "components")
    placed = distinct.join(comps, distinct.fp == comps.node, "left").select("fp", "lo", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("lo").alias("_component"))
    by_fp = placed.join(least, "root").select("fp", "_component", F.col("root").alias("_root"))
    out = marked.join(by_fp, "fp")
    real = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return out.select(real("_id").alias(id_col), "_id", "_th", F.col("fp").alias("_fp"), "_root", real("_component").alias("_component"))


def simhash_keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **params) -> DataFrame:
    """docs with one row left of each component: the one of the least id (of equal ids, the least text hash)."""
    marked = simhash_components(docs, text_col, id_col, **params)
    stay = marked.groupBy("_root").agg(F.min(F.struct("_id", "_th")).alias("r")).select("r._id", "r._th")
    shield = Shield(docs, text_col, id_col)
    return shield.restore(shield.keyed().join(stay, ["_id", "_th"]).dropDuplicates(["_id", "_th"]))
