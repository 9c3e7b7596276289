"""Approximate nearest neighbours by learned partitions.

Fit, on a bounded sample (`sample` distinct vectors, least hash first): a neighbour graph, cut into balanced partitions
by repeated spectral bisection with swaps that lower the cut; then a small network learns to give, for a vector, the share
of its neighbours in each partition. Index: every vector goes to its most probable partition. Search: a query goes to
its several most probable partitions, as many as the sample needs for `recall` of its own neighbours, and is reranked there
by exact inner products in double precision, block against block.

The number of partitions doubles while each has 60 vectors and 48 of the sample, so it grows with the table up to what the
sample can teach (128 with the default); below 120 distinct vectors there is one, and the search is exact. Where vectors are
spread evenly in all directions, most partitions are needed; that is measured, not assumed.

Copies of a vector are one entry with its `keep` + 1 least ids: more can't be among the first `keep`, as ties go to smaller
ids. A partition of over `block` vectors is several blocks, and over `block` queries of one partition are several shares; each block
meets each share in a task of its own, so no task grows with the table.
Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part; nor
rows with a null id; repeated rows count once. Vectors may be of any length, so long as components are finite: a product beyond the range of doubles is
infinite, and one whose parts cancel as infinities comes last, as minus infinity. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.keys import bounded_sample
from rosterlake.tables import materialise


def _valid(dim: int, keep: int):
    """Distinct vectors of a batch, each with its keep + 1 least ids."""

    def run(batches):
        for rows in batches:
            fit = pc.and_(pc.equal(pc.fill_null(pc.list_value_length(rows.column("v")), -1), dim), pc.is_valid(rows.column("id")))
            rows = rows.filter(fit)
            if not rows.num_rows:
                continue
            own = rows.column("id").to_numpy()
            x = pc.fill_null(rows.column("v").flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
            fine = np.isfinite(x).all(1) & (x != 0).any(1)
            x, own = x[fine] + 0.0, own[fine]
            if not len(x):
                continue
            key, inverse = np.unique(x, axis=0, return_inverse=True)
            o = np.lexsort((own, inverse.ravel()))
            first = np.flatnonzero(np.r_[True, np.diff(inverse.ravel()[o]) > 0])
            lists = [np.unique(c)[: keep + 1].tolist() for c in np.split(own[o], first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in key], pa.binary()), pa.array(lists, pa.list_(pa.int64()))], names=["x", "ids"])

    return run


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _bisect(nodes: np.ndarray, near: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """True for half of the nodes: the side of the graph's second eigenvector, then swaps that cut fewer edges."""
    where = np.full(len(near), -1)
    where[nodes] = np.arange(len(nodes))
    local = where[near[nodes]]
    u, v = np.repeat(np.arange(len(nodes)), local.shape[1]), local.ravel()
    u, v = u[v >= 0], v[v >= 0]
    u, v = np.r_[u, v], np.r_[v, u]
    deg = np.maximum(np.bincount(u, minlength=len(nodes)), 1).astype(float)
    f = rng.standard_normal(len(nodes))
    for _ in range(80):
        f -= (f * deg).sum() / deg.sum()
        f = 0.5 * f + 0.5 * np.bincount(u, f[v], len(nodes)) / deg
        f /= np.sqrt((f * f).sum()) + 1e-300
    side = np.zeros(len(nodes), bool)
    side[np.argsort(f, kind="stable")[len(nodes) // 2 :]] = True
    for _ in range(8):
        pull = np.bincount(u, np.where(side[v], 1.0, -1.0), len(nodes))
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(pull[a], kind="stable")], b[np.argsort(-pull[b], kind="stable")]
        n = min(len(a), len(b))
        gain = np.flatnonzero(pull[b[:n]] - pull[a[:n]] > 2)[: max(1, n // 10)]
        if not len(gain):
            break
        side[a[gain]], side[b[gain]] = False, True
    return side


def balanced_partition(near: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    groups = [np.arange(len(near))]
    while len(groups) < parts:
        groups = [h for g in groups for side in [_bisect(g, near, rng)] for h in (g[~side], g[side])]
    label = np.empty(len(near), np.int64)
    for i, g in enumerate(groups):
        label[g] = i
    return label


class Router:
    """Inputs to partition probabilities by one hidden layer."""

    def __init__(self, dim: int, parts: int, hidden: int = 128, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = [rng.standard_normal((dim, hidden)) * (2 / dim) ** 0.5, np.zeros(hidden), rng.standard_normal((hidden, parts)) * hidden**-0.5, np.zeros(parts)]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 3e-3, seed: int = 5) -> Router:
        rng = np.random.default_rng(seed)
        m, s, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                a, b = x[order[i : i + batch]], y[order[i : i + batch]]
                h = np.maximum(a @ self.p[0] + self.p[1], 0)
                z = h @ self.p[2] + self.p[3]
                z = np.exp(z - z.max(1, keepdims=True))
                d = (z / z.sum(1, keepdims=True) - b) / len(a)
                back = (d @ self.p[2].T) * (h > 0)
                t += 1
                for k, g in enumerate((a.T @ back, back.sum(0), h.T @ d, d.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        return self


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows at length 1, by their greatest component first, so neither squares of large nor of small components leave the range."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_router(x: np.ndarray, parts: int, k: int, recall: float) -> tuple[Router, int]:
    """The router and how many partitions a query needs, measured on a fifth of the sample that training doesn't see."""
    unit = unit_rows(x)
    x = x / np.abs(x).max()  # products keep their order, but for those that come to nothing beside the largest
    near = neighbour_graph(x, min(10, len(x) - 1))
    label = balanced_partition(near, parts)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.repeat(np.arange(len(x)), near.shape[1]), label[near].ravel()), 1 / (near.shape[1] + 1))
    soft[np.arange(len(x)), label] += 1 / (near.shape[1] + 1)
    test = np.arange(len(x)) % 5 == 0
    router = Router(x.shape[1], parts).fit(unit[~test], soft[~test])
    p = router.probabilities(unit)
    home = p.argmax(1)
    rank = np.empty_like(p, np.int64)
    np.put_along_axis(rank, np.argsort(-p, axis=1, kind="stable"), np.arange(parts)[None, :].repeat(len(p), 0), axis=1)
    true = neighbour_graph(x, min(k, len(x) - 1))
    at = rank[np.flatnonzero(test)[:, None], home[true[test]]]
    probes = next((c for c in range(1, parts + 1) if (at < c).mean() >= recall), parts)
    return router, probes


def _route(router: Router, dim: int, probes: int, query: bool, every: int):
    def run(batches):
        for rows in batches:
            raw = rows.column("x").to_pylist()
            if not raw:
                continue
            x = np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)
            p = router.probabilities(unit_rows(x))
            if not query:
                yield pa.RecordBatch.from_arrays([pa.array(p.argmax(1).astype(np.int32)), rows.column("x"), rows.column("ids")], names=["part", "x", "ids"])
                continue
            top = np.argsort(-p, axis=1, kind="stable")[:, :probes]
            take = np.repeat(np.arange(len(x)), probes)
            yield pa.RecordBatch.from_arrays([pa.array(top.ravel().astype(np.int32)), rows.column("q").take(pa.array(take)), rows.column("x").take(pa.array(take))], names=["part", "q", "x"])

    return run


def _rerank(dim: int, keep: int, hold: int = 256):
    def run(left, right):
        raw = left.column("x").to_pylist()
        kind = pa.list_(pa.struct([("neg", pa.float64()), ("vec_id", pa.int64())]))
        empty = pa.table({"query_id": pa.array([], pa.int64()), "salt": pa.array([], pa.int32()), "top": pa.array([], kind)})
        if not raw or not right.num_rows:
            return empty
        x = np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)
        ids = left.column("ids").to_pylist()
        qid, q = right.column("q").to_numpy(), np.frombuffer(b"".join(right.column("x").to_pylist()), np.float64).reshape(-1, dim)
        salt = int(left.column("part")[0].as_py() + left.column("b")[0].as_py() * 31) % 16
        tops = []
        take, longest = min(keep + 1, len(x)), np.abs(x).max()
        for i in range(0, len(q), hold):
            with np.errstate(over="ignore", invalid="ignore"):
                s = q[i : i + hold] @ x.T
                s[np.isnan(s)] = -np.inf
                edge = np.partition(s, len(x) - take, axis=1)[:, len(x) - take]
                # what rounding may move: some units in the last place of the longest product
                slack = 1e-15 * dim * np.abs(q[i : i + hold]).max(1) * dim * longest
            for j in range(len(s)):
                c = np.flatnonzero(~(s[j] < edge[j] - slack[j]))
                with np.errstate(over="ignore", invalid="ignore"):
                    exact = (x[c] * q[i + j]).sum(1)
                exact[np.isnan(exact)] = -np.inf
                flat = [(-e, v) for e, w in zip(exact.tolist(), c) for v in ids[w] if v != qid[i + j]]
                flat.sort()
                tops.append([{"neg": e, "vec_id": v} for e, v in flat[:keep]])
        return pa.table({"query_id": pa.array(qid, pa.int64()), "salt": pa.array(np.full(len(q), salt, np.int32)), "top": pa.array(tops, kind)})

    return run


def partition_search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", keep: int = 20, every: int = 20, sample: int = 8192, recall: float = 0.94, block: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose id is divisible by `every`, the `keep` nearest found."""
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = src.where("v is not null and size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not dims:
        return empty
    dim = dims["d"]
    seen = src.mapInArrow(_valid(dim, keep), "x binary, ids array<bigint>")
    entry = seen.groupBy("x").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep + 1).alias("ids"))
    entry = materialise(entry, "vectors")
    n = entry.count()
    if n == 0:
        return empty
    raw = [r["x"] for r in bounded_sample(entry.select("x"), ["x"], sample, n).collect()]
    x = np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)
    parts = 1
    while n // (parts * 2) >= 60 and len(x) // (parts * 2) >= 48:
        parts *= 2
    router, probes = fit_router(x, parts, keep, recall) if parts > 1 else (Router(dim, 1), 1)
    index = materialise(entry.mapInArrow(_route(router, dim, 1, False, every), "part int, x binary, ids array<bigint>"), "index")
    held = [r["count"] for r in index.groupBy("part").count().collect()]  # a row a partition at most
    held = sorted([0] * (parts - len(held)) + held)
    while probes < parts and sum(held[:probes]) <= keep:  # even the emptiest partitions give a full list
        probes += 1
    # every query: a hot vector's ids beyond the least ones ask too
    asks = src.where((F.col("id") % every) == 0).mapInArrow(_valid(dim, 1 << 40), "x binary, ids array<bigint>").select(F.explode("ids").alias("q"), "x").distinct()
    routed = materialise(asks.mapInArrow(_route(router, dim, probes, True, every), "part int, q long, x binary"), "routed")
    deals = lambda df, name: df.groupBy("part").count().select("part", F.ceil(F.col("count") / block).cast("int").alias(name))
    sizes = materialise(deals(index, "blocks").join(deals(routed, "shares"), "part"), "sizes")  # a row a partition at most
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    dealt = index.join(F.broadcast(sizes), "part").select("part", own("x", "blocks").alias("b"), each("shares").alias("w"), "x", "ids")
    asked = routed.join(F.broadcast(sizes), "part").select("part", each("blocks").alias("b"), own("q", "shares").alias("w"), "q", "x")
    near = dealt.groupBy("part", "b", "w").cogroup(asked.groupBy("part", "b", "w")).applyInArrow(_rerank(dim, keep), "query_id long, salt int, top array<struct<neg:double,vec_id:long>>")
    # a query's lists meet in two steps, so no list grows with the number of blocks
    first = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, keep)
    some = near.groupBy("query_id", "salt").agg(first("top").alias("top"))
    best = some.groupBy("query_id").agg(first("top").alias("top"))
    out = best.select("query_id", F.posexplode("top").alias("pos", "t"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.neg")).alias("score"))
