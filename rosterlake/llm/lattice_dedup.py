"""Near-duplicate vectors by E8 lattice hashing.

Equal vectors are one class with a count. In each of several tables a unit vector is projected on 8 random directions, scaled, shifted
and decoded to the nearest point of the lattice E8 (the 8 whole numbers of even sum, or all of them plus a half): its cell. It is filed in that
cell and probes the `probes` neighbouring cells (of the 240 at least distance) that its projection leans to most. Vectors that meet in a cell
are compared there by cosine in double precision, block against block, and only counts, and spanning links of what is connected, leave the task: no
list of pairs. A pair is counted in the first place where it meets; a task that finds a pair computes the two vectors' cells
anew to see whether it is that place, so nothing has to be told apart by a shuffle.

The scale is the least at which a vector of n without near copies meets about `crowd` others a table; the number of tables is what brings the
chance to miss a pair of exactly the least cosine under `miss`, by the hit rate of drawn pairs (`plan`). So both follow n, and
the results don't depend on them but for that chance.

Dense groups: where a cell of the first table has over DENSE classes, a pivot is chosen from DENSE of them, and those within half
the linking angle of it are a ball: any two of them are linked, so they are counted and tied to each other without being compared,
in whatever cell they meet. What shares a cell of over BLOCK rows is dealt in blocks, by ball first, and each two blocks meet in a task of their own unless both
are of one ball; that holds for groups of any size, and is the exact way for the rest.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different lengths; each
is its own component, and components as small as 1e-300 or as large as 1e300 count. A null id takes part and comes last. Repeated rows are other
vectors that are linked. An empty table gives an empty result. Added columns are _links and _component; columns of these names are replaced.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.llm.graph import connected_components
from rosterlake.llm.keys import LAST, Shield, join_hot, null_last
from rosterlake.llm.order import broadcast_few
from rosterlake.tables import forget, materialise

DENSE, BLOCK, LEAST_BALL = 256, 4096, 64
ADDED = ("_links", "_component")


def _half_vectors() -> np.ndarray:
    """The 240 lattice points next to 0: two entries of one, or eight of a half with an even number of minus signs."""
    pairs = [(i, j, a, b) for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    ones = np.zeros((len(pairs), 8))
    for k, (i, j, a, b) in enumerate(pairs):
        ones[k, i], ones[k, j] = a, b
    halves = np.array([s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])
    return np.r_[ones, halves]


NEXT = _half_vectors()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest points of whole numbers with an even sum: rounding, and where the sum is odd the entry that was rounded farthest goes the other way."""
    near = np.rint(x)
    off = x - near
    rows, worst = np.arange(len(x)), np.abs(off).argmax(1)
    near[rows, worst] += np.where(near.sum(1) % 2 != 0, np.where(off[rows, worst] >= 0, 1, -1), 0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


class Lattice:
    """Cells of unit vectors of one length, as 64-bit keys."""

    def __init__(self, dim: int, scale: float, tables: int, probes: int, seed: int = 3):
        rng = np.random.default_rng([seed, dim])
        self.axes = rng.standard_normal((tables, dim, 8)) * scale
        self.shift = rng.uniform(-8, 8, (tables, 8))
        self.tables, self.probes = tables, probes
        self.odd = rng.integers(0, 1 << 63, (tables, 8), dtype=np.uint64) | np.uint64(1)

    def _key(self, t: int, points: np.ndarray) -> np.ndarray:
        h = ((2 * points).astype(np.int64).view(np.uint64) * self.odd[t]).sum(-1, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ (h >> np.uint64(29))).view(np.int64)

    def cells(self, unit: np.ndarray, hold: int = 2048) -> np.ndarray:
        """(rows, tables, 1 + probes): the own cell, then the neighbours most leaned to."""
        out = np.empty((len(unit), self.tables, 1 + self.probes), np.int64)
        for i in range(0, len(unit), hold):
            for t in range(self.tables):
                p = unit[i : i + hold] @ self.axes[t] + self.shift[t]
                c = decode(p)
                lean = (p - c) @ NEXT.T
                out[i : i + hold, t, 0] = self._key(t, c)
                if self.probes:
                    top = np.argpartition(-lean, self.probes, axis=1)[:, : self.probes]
                    out[i : i + hold, t, 1:] = self._key(t, c[:, None, :] + NEXT[top])
        return out


def plan(n: int, least: float, crowd: int = 4096, probes: int = 4, miss: float = 1e-6) -> tuple[float, int]:
    """(scale, tables) for n vectors."""
    rng = np.random.default_rng(17)
    dim, drawn = 32, 8192
    x, y = rng.standard_normal((2, drawn, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = least * x + (1 - least**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
    scale = 0.6
    # unrelated vectors of n share a cell at a rate of (4 pi scale^2)^-4, the chance that two normal points of 8 dimensions do
    while n * (1 + 2 * probes) / (4 * np.pi * scale**2) ** 4 > crowd:
        scale *= 1.05
    lattice = Lattice(dim, scale, 4, probes)
    a, b = lattice.cells(x), lattice.cells(y)
    hit = _meet(a, b).mean()
    return scale, max(1, int(np.ceil(np.log(miss) / np.log(max(1e-9, 1 - hit)))))


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows meet in each table: they share a cell, or one probes the other's."""
    return (a == b[:, :, :1]).any(2) | (b == a[:, :, :1]).any(2)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _bytes(batches):
    """Vectors as bytes of their own kind of numbers, null where they can't be compared; -0 is 0."""
    for rows in batches:
        v = rows.column("v")
        lens = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
        flat = pc.fill_null(v.flatten(), float("nan")).to_numpy(zero_copy_only=False) + v.type.value_type.to_pandas_dtype()(0)
        ends = np.cumsum(lens)
        bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
        some = np.r_[0, np.cumsum(flat != 0)]
        fine = (bad[ends] == bad[ends - lens]) & (some[ends] > some[ends - lens])
        x = [flat[e - n : e].tobytes() if ok else None for e, n, ok in zip(ends.tolist(), lens.tolist(), fine.tolist())]
        yield pa.RecordBatch.from_arrays([*[rows.column(i) for i, c in enumerate(rows.schema.names) if c != "v"], pa.array(x, pa.binary())], names=[*[c for c in rows.schema.names if c != "v"], "x"])


def _by_length(raw: list[bytes], kind: str):
    """(positions, matrix of doubles) of the vectors of each length."""
    lens = np.array([len(r) for r in raw])
    for n in np.unique(lens):
        at = np.flatnonzero(lens == n)
        yield at, np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), -1).astype(np.float64)


def _file(kind: str, scale: float, tables: int, probes: int, own_only: bool = False):
    """Rows of each class for the cells it is filed in (own) and probes, of all tables or, own_only, of the first."""

    def run(batches):
        for rows in batches:
            raw = rows.column("x").to_pylist()
            for at, x in _by_length(raw, kind) if raw else ():
                lattice = Lattice(x.shape[1], scale, tables, probes)
                cells = lattice.cells(unit_rows(x))
                cells = cells[:, :1, :1] if own_only else cells
                n, t, k = cells.shape
                take = pa.array(np.repeat(at, t * k))
                names = [*rows.schema.names, "t", "cell", "own"]
                extra = [np.tile(np.repeat(np.arange(t, dtype=np.int32), k), n), cells.ravel() ^ np.int64(x.shape[1] << 20), np.tile(np.arange(k) == 0, n * t)]
                out = pa.RecordBatch.from_arrays([*[c.take(take) for c in rows.columns], *map(pa.array, extra)], names=names)
                for i in range(0, out.num_rows, 8192):
                    yield out.slice(i, 8192)

    return run


def _pivot(kind: str, least: float):
    """The middle of the largest group of the rows that lie within half the linking angle of one of them."""
    half = ((1 + least) / 2) ** 0.5

    def run(rows: pa.Table) -> pa.Table:
        _, x = next(_by_length(rows.column("x").to_pylist(), kind))  # a cell is of one length
        x = unit_rows(x)
        near = x @ x.T >= half
        mid = x[near[near.sum(1).argmax()]].sum(0)
        return pa.table({"cell": rows.column("cell").slice(0, 1), "pivot": pa.array([mid.tobytes()], pa.binary())})

    return run


def _in_ball(kind: str, least: float):
    half = ((1 + least) / 2) ** 0.5 + 1e-9

    def run(batches):
        for rows in batches:
            if rows.num_rows:
                x, p = rows.column("x").to_pylist(), rows.column("pivot").to_pylist()
                inside = np.zeros(len(x), bool)
                for at, v in _by_length(x, kind):
                    mid = np.frombuffer(b"".join(p[i] for i in at), np.float64).reshape(v.shape)
                    inside[at] = (unit_rows(v) * unit_rows(mid)).sum(1) >= half
                yield pa.RecordBatch.from_arrays([rows.column("c"), rows.column("copies"), rows.column("cell")], names=["c", "copies", "ball"]).filter(pa.array(inside))

    return run


def balls_of(classes: DataFrame, kind: str, least: float, scale: float) -> DataFrame:
    """(c, head, weight) of the classes that are in a ball: its least class and its vectors; any two of one ball are linked."""
    filed = materialise(classes.select("c", "copies", "x").mapInArrow(_file(kind, scale, 1, 0, True), "c long, copies long, x binary, t int, cell long, own boolean"), "filed")
    dense = materialise(filed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > DENSE), "dense")
    some = filed.join(broadcast_few(dense), "cell").where(F.pmod(F.xxhash64("x"), F.col("n")) < 2 * DENSE)
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("x"), "c"))
    some = some.withColumn("_k", rank).where(F.col("_k") <= DENSE).select("cell", "x")
    pivots = materialise(some.groupBy("cell").applyInArrow(_pivot(kind, least), "cell long, pivot binary"), "pivots")
    inside = materialise(filed.join(broadcast_few(pivots, 10_000), "cell").mapInArrow(_in_ball(kind, least), "c long, copies long, ball long"), "inside")
    large = inside.groupBy("ball").agg(F.sum("copies").alias("weight"), F.count("*").alias("n"), F.min("c").alias("head")).where(F.col("n") >= LEAST_BALL)
    large = materialise(large.select("ball", "head", "weight"), "large")
    out = materialise(inside.join(broadcast_few(large), "ball").select("c", "head", "weight"), "balls")
    forget(filed, dense, pivots, inside)
    return out


def _compare(kind: str, least: float, scale: float, tables: int, probes: int):
    """Groups of rows (t, cell, task) in order -> (c, n, to): to c come n links, or it is tied to `to`."""

    def group(t: int, side: np.ndarray, own: np.ndarray, c: np.ndarray, copies: np.ndarray, ball: np.ndarray, raw: list[bytes]):
        for at, x in _by_length(raw, kind):
            left, right = (at[side[at] != 1], at[side[at] != 0])  # 2: both sides
            if not len(left) or not len(right):
                continue
            u = np.empty((len(raw), x.shape[1]))
            u[at] = unit_rows(x)
            found = []
            for i in range(0, len(left), 512):
                a = left[i : i + 512]
                i0, j0 = np.nonzero(u[a] @ u[right].T >= least)
                p, q = a[i0], right[j0]
                ok = (c[p] != c[q]) & ((ball[p] != ball[q]) | (ball[p] < 0)) & (own[p] | own[q])
                ok &= ~((side[p] == 2) & (side[q] == 2)) | (c[p] < c[q])
                found.append((p[ok], q[ok]))
            p, q = (np.concatenate(f) for f in zip(*found))
            if not len(p):
                continue
            used, back = np.unique(np.r_[p, q], return_inverse=True)
            p, q = back[: len(p)], back[len(p) :]
            lattice = Lattice(x.shape[1], scale, tables, probes)
            cells = lattice.cells(u[used])
            owned, cc = own[used], c[used]
            first = np.zeros(len(p), bool)
            for i in range(0, len(p), 1 << 15):
                a, b = cells[p[i : i + (1 << 15)]], cells[q[i : i + (1 << 15)]]
                before = _meet(a[:, :t], b[:, :t]).any(1) if t else np.zeros(len(a), bool)
                # in this table: in the shared cell if there is one, else in the cell of the smaller class if the other probes it
                a, b = a[:, t], b[:, t]
                shared = a[:, 0] == b[:, 0]
                small = cc[p[i : i + (1 << 15)]] < cc[q[i : i + (1 << 15)]]
                s, g = np.where(small[:, None], a, b), np.where(small[:, None], b, a)
                in_small = (g[:, 1:] == s[:, :1]).any(1)
                own_small = np.where(small, owned[p[i : i + (1 << 15)]], owned[q[i : i + (1 << 15)]])
                both = owned[p[i : i + (1 << 15)]] & owned[q[i : i + (1 << 15)]]
                here = np.where(shared, both, np.where(in_small, own_small & ~both, ~own_small))
                first[i : i + (1 << 15)] = ~before & here
            p, q = p[first], q[first]
            if not len(p):
                continue
            weight = copies[used]
            n = np.bincount(p, weight[q], len(used)) + np.bincount(q, weight[p], len(used))
            root = np.arange(len(used))
            while True:
                low = root.copy()
                np.minimum.at(low, p, root[q])
                np.minimum.at(low, q, root[p])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            hit = np.flatnonzero(n)
            yield cc[hit], n[hit].astype(np.int64), cc[root[hit]]

    def run(batches):
        held: list[pa.Table] = []

        def flush(rows: pa.Table):
            key = np.stack([rows.column(k).to_numpy() for k in ("cell", "t", "task")])
            cut = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, rows.num_rows]
            side, own = rows.column("side").to_numpy(), rows.column("own").to_numpy(zero_copy_only=False)
            c, copies, ball = (rows.column(k).to_numpy() for k in ("c", "copies", "ball"))
            x = rows.column("x")
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if b - a > 1 and own[a:b].any():
                    yield from group(int(key[1, a]), side[a:b], own[a:b], c[a:b], copies[a:b], ball[a:b], x.slice(a, b - a).to_pylist())

        def packed(parts):
            parts = list(parts)
            if parts:
                columns = [pa.array(np.concatenate(col)) for col in zip(*parts)]
                yield pa.RecordBatch.from_arrays(columns, names=["c", "n", "to"])

        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                rows = pa.concat_tables(held)
                last = [rows.column(k)[rows.num_rows - 1].as_py() for k in ("cell", "t", "task")]
                same = np.ones(rows.num_rows, bool)
                for k, v in zip(("cell", "t", "task"), last):
                    same &= rows.column(k).to_numpy() == v
                keep = int(same.argmax())
                if keep:
                    yield from packed(flush(rows.slice(0, keep).combine_chunks()))
                held = [rows.slice(keep)]
        if held:
            yield from packed(flush(pa.concat_tables(held).combine_chunks()))

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    """rows(t, cell, own, c, copies, ball, x), a table, with task and side: a small cell is one task in which all meet (side 2);
    in a large one, blocks meet two by two (sides 0 and 1), and a block itself (2) unless it is all of one ball or none of it is filed there."""
    on = ["t", "cell"]
    kinds = rows.groupBy(*on, "own", "ball").agg(F.count("*").alias("n"))
    kinds = kinds.withColumn("all", F.sum("n").over(Window.partitionBy(*on))).where(F.col("all") > BLOCK)
    kinds = kinds.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    kinds = materialise(kinds, "kinds")
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b")
    blocks = materialise(kinds.select(*on, "own", "ball", block), "blocks")
    a = blocks.select(*on, *[F.col(k).alias(f"{k}1") for k in ("own", "ball", "b")])
    b = blocks.select(*on, *[F.col(k).alias(f"{k}2") for k in ("own", "ball", "b")])
    key = lambda i: F.struct(~F.col(f"own{i}"), f"ball{i}", f"b{i}")
    met = a.join(b, on).where((key(1) <= key(2)) & F.col("own1") & ((F.col("ball1") != F.col("ball2")) | (F.col("ball1") < 0)))
    met = met.withColumn("task", F.xxhash64(*[f"{k}{i}" for i in (1, 2) for k in ("own", "ball", "b")]))
    alone = key(1) == key(2)
    first = met.select(*on, F.col("own1").alias("own"), F.col("ball1").alias("ball"), F.col("b1").alias("b"), "task", F.when(alone, 2).otherwise(0).alias("side"))
    second = met.where(~alone).select(*on, F.col("own2").alias("own"), F.col("ball2").alias("ball"), F.col("b2").alias("b"), "task", F.lit(1).alias("side"))
    turns = materialise(first.unionByName(second), "turns")
    sized = rows.join(broadcast_few(kinds.select(*on, "own", "ball", "blocks")), [*on, "own", "ball"], "left").withColumn("b", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    dealt = sized.join(broadcast_few(turns), [*on, "own", "ball", "b"], "left").where(F.col("blocks").isNull() | F.col("task").isNotNull())
    return dealt.select(*on, "own", "c", "copies", "ball", "x", F.coalesce("task", F.lit(0)).alias("task"), F.coalesce("side", F.lit(2)).alias("side"))


def lattice_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, probes: int = 4, miss: float = 1e-6, crowd: int = 4096) -> DataFrame:
    """vectors with _links, how many others are linked directly, and _component, the least id reachable; the vectors are not carried."""
    shield = Shield(vectors, vec_col, id_col)
    own = [c for c in shield.own if c != "text"]
    src = shield.df.select(*own, F.col("text").alias("v"))
    kind = "<f4" if src.schema["v"].dataType.elementType.typeName() == "float" else "<f8"
    src = src if kind == "<f4" else src.withColumn("v", F.col("v").cast("array<double>"))
    rows = materialise(src.mapInArrow(_bytes, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "v") + ", x binary"), "rows")
    classes = rows.where("x is not null").groupBy("x").agg(F.count("*").alias("copies"), F.min(null_last(F.col(shield.id))).alias("low"))
    classes = materialise(materialise(classes, "distinct").withColumn("c", F.monotonically_increasing_id()), "classes")
    scale, tables = plan(classes.count(), least, crowd, probes, miss)
    balls = balls_of(classes, kind, least, scale)
    filed = classes.join(balls.select("c", F.col("head").alias("ball")), "c", "left").select("c", "copies", F.coalesce("ball", F.lit(-1)).alias("ball"), "x")
    filed = materialise(filed, "filed").mapInArrow(_file(kind, scale, tables, probes), "c long, copies long, ball long, x binary, t int, cell long, own boolean")
    met = _dealt(filed).repartition("t", "cell", "task").sortWithinPartitions("cell", "t", "task")
    met = materialise(met.mapInArrow(_compare(kind, least, scale, tables, probes), "c long, n long, to long"), "met")
    linked = met.groupBy("c").agg(F.sum("n").alias("n"))
    ties = met.select(F.col("c").alias("u"), F.col("to").alias("v")).unionByName(balls.select(F.col("c").alias("u"), F.col("head").alias("v")))
    roots = materialise(connected_components(ties), "roots")
    group = classes.join(roots.withColumnRenamed("node", "c"), "c", "left").join(linked, "c", "left").join(balls.select("c", "weight"), "c", "left")
    group = group.select("x", "copies", "low", F.coalesce("root", "c").alias("root"), (F.coalesce("n", F.lit(0)) + F.coalesce("weight", "copies") - 1).alias("_links"))
    group = materialise(group, "linked")
    lows = materialise(group.groupBy("root").agg(F.min("low").alias("_component")), "lows")
    side = group.join(lows, "root").select("x", "copies", "_links", F.when(F.col("_component") != LAST, F.col("_component")).alias("_component"))
    known = join_hot(rows.where("x is not null"), materialise(side, "side"), ["x"], "inner", "copies")
    alone = rows.where("x is null").withColumns({"_links": F.lit(0).cast("long"), "_component": F.col(shield.id).cast("long")})
    out = known.select(*own, *ADDED).unionByName(alone.select(*own, *ADDED))
    return out.select(*[F.col(c).alias(n) for c, n in zip(shield.own, shield.names) if c != "text" and n not in ADDED], *ADDED)
