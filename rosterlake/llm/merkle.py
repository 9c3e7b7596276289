"""Merkle manifest of a dataset: a tree a group, a tree over the groups, and proofs by coordinates.

A leaf is the SHA-256 of a row's columns in turn, each as its UTF-8 byte count, `:` and its value, or `-` for null. The leaves of a
group, ordered by an id, are the lowest level of its tree; every `fanout` consecutive nodes (the last run may be shorter, even one)
make a node, the SHA-256 of their digests as hex text, until one is left. The groups' roots, ordered by group, make a tree likewise.

Where a node lies follows from the place of its leaf and the size of its group alone: at level l, place // fanout^l of
ceil(size / fanout^l). So a proof needs no walk: each leaf explodes the coordinates of the siblings it needs, the table of
nodes is joined, and what comes back is ordered and folded.

Nodes near a root are asked for by many leaves. They are few: from the lowest level on at which the nodes above it number
at most FEW, counted from the sizes, they are broadcast; below it a node is asked for by fanout^level leaves, and the join shuffles.
Nodes are made in blocks of at most BLOCK children that share an ancestor, so no task holds a group.

Nulls: a null column is `-`; a null group comes first, as does a null id. Rows of equal id are ordered by their leaf; equal rows
have a place and a proof each. Texts are hashed whole in the JVM, empty ones as `0:`. An empty table has no leaves, no nodes and no root. Columns besides
those named are not read; of columns of one name the first counts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.keys import distinct_names
from rosterlake.llm.order import FEW, broadcast_few, placed
from rosterlake.tables import materialise

BLOCK = 4096
#: The tree over the groups' roots.
TOP = -1
_NODE = "tree long, level int, pos long, digest binary"


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_of(columns: list[Column]) -> Column:
    """Digest of a row, binary."""
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return F.unhex(F.sha2(F.concat(*[part(c) for c in columns]), 256))


def depth_of(size: Column, fanout: int) -> Column:
    """Levels above the lowest: the least d with fanout^d >= size."""
    powers = [fanout**k for k in range(1, 64) if fanout**k < 1 << 62]
    return F.aggregate(F.array(*[F.lit(p) for p in [1, *powers[:-1]]]), F.lit(0), lambda d, p: d + F.when(p < size, 1).otherwise(0))


def _raise(fanout: int, steps: int):
    """The levels over a block of nodes, up to `steps` of them or the root."""

    def run(block: pa.Table) -> pa.Table:
        tree, low, size = (block.column(c)[0].as_py() for c in ("tree", "level", "size"))
        pairs = sorted(zip(block.column("pos").to_pylist(), block.column("digest").to_pylist()))
        first, now, out = pairs[0][0], [d.hex() for _, d in pairs], []
        for level in range(low + 1, low + steps + 1):
            if size == 1:
                break
            now = [hashlib.sha256("".join(now[i : i + fanout]).encode()).hexdigest() for i in range(0, len(now), fanout)]
            first, size = first // fanout, -(-size // fanout)
            out += [(level, first + i, bytes.fromhex(d)) for i, d in enumerate(now)]
        n = len(out)
        columns = [pa.array([tree] * n, pa.int64()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())]
        return pa.Table.from_arrays(columns, names=["tree", "level", "pos", "digest"])

    return run


def grow(leaves: DataFrame, fanout: int) -> DataFrame:
    """leaves(tree, pos, size, digest), pos from 0 to size - 1 in each tree -> nodes(tree, level, pos, digest), the leaves as level 0."""
    steps = 1
    while fanout ** (steps + 1) <= BLOCK:
        steps += 1
    nodes = level = materialise(leaves.select("tree", F.lit(0).alias("level"), "pos", "digest"), "nodes")
    sizes = materialise(leaves.select("tree", F.col("size").alias("leaves")).distinct(), "sizes")
    largest, low = sizes.agg(F.max("leaves")).first()[0] or 0, 0
    while largest > fanout**low:
        size = F.ceil(F.col("leaves") / F.lit(fanout**low))
        base = level.join(broadcast_few(sizes), "tree").withColumn("size", size.cast("long")).where("size > 1")
        base = base.withColumn("block", F.floor(F.col("pos") / fanout**steps).cast("long"))
        made = materialise(base.groupBy("tree", "block").applyInArrow(_raise(fanout, steps), _NODE), "nodes")
        nodes = nodes.unionByName(made)
        low += steps
        level = made.where(F.col("level") == low)
    return nodes


def coordinates(place: Column, size: Column, fanout: int) -> Column:
    """Array of (level, pos) of the siblings on the way from a place to the root."""

    def at(level: Column) -> Column:
        width = F.pow(F.lit(float(fanout)), level).cast("long")
        own, nodes = F.floor(place / width), F.ceil(size / width)
        run = own - own % fanout
        every = F.sequence(run, F.least(run + fanout, nodes) - 1)
        return F.transform(F.filter(every, lambda p: p != own), lambda p: F.struct(level.cast("int").alias("level"), p.cast("long").alias("pos")))

    depth = depth_of(size, fanout)
    return F.when(depth > 0, F.flatten(F.transform(F.sequence(F.lit(0), depth - 1), at))).otherwise(F.array().cast("array<struct<level:int,pos:bigint>>"))


def siblings(leaves: DataFrame, nodes: DataFrame, fanout: int) -> DataFrame:
    """leaves(tree, pos, size) -> (tree, pos, path), path an ordered array of (level, pos, digest) of siblings; leaves that
    need none are absent."""
    asked = leaves.select("tree", F.col("pos").alias("of"), F.explode(coordinates(F.col("pos"), F.col("size"), fanout)).alias("c"))
    asked = asked.select("tree", "of", "c.level", "c.pos")
    per = nodes.groupBy("level").count().collect()  # a row a level
    top, held = max((r["level"] for r in per), default=0) + 1, 0
    for r in sorted(per, key=lambda r: -r["level"]):
        if held + r["count"] > FEW:
            break
        top, held = r["level"], held + r["count"]
    on = ["tree", "level", "pos"]
    high = asked.where(F.col("level") >= top).join(F.broadcast(nodes.where(F.col("level") >= top)), on)
    low = asked.where(F.col("level") < top).join(nodes.where(F.col("level") < top), on)
    found = high.unionByName(low).groupBy("tree", "of").agg(F.array_sort(F.collect_list(F.struct("level", "pos", "digest"))).alias("path"))
    return found.select("tree", F.col("of").alias("pos"), "path")


def fold(leaf: Column, place: Column, size: Column, path: Column, fanout: int) -> Column:
    """Digest (hex) of the root that a leaf (hex) and its siblings give: at each level the siblings before it, itself, and
    those after it are concatenated and hashed."""
    depth = depth_of(size, fanout)
    own = F.transform(
        F.when(depth > 0, F.sequence(F.lit(0), depth - 1)).otherwise(F.array().cast("array<int>")),
        lambda l: F.struct(l.cast("int").alias("level"), F.floor(place / F.pow(F.lit(float(fanout)), l).cast("long")).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest")),
    )
    steps = F.array_sort(F.concat(F.coalesce(path, F.array().cast("array<struct<level:int,pos:bigint,digest:binary>>")), own))
    start = F.struct(F.lit(0).alias("level"), F.lit("").alias("held"), leaf.alias("up"))

    def step(s: Column, x: Column) -> Column:
        next_level = x["level"] > s["level"]
        up = F.when(next_level, F.sha2(s["held"], 256)).otherwise(s["up"])
        held = F.when(next_level, F.lit("")).otherwise(s["held"])
        return F.struct(x["level"].alias("level"), F.concat(held, F.coalesce(hexed(x["digest"]), up)).alias("held"), up.alias("up"))

    return F.when(depth > 0, F.aggregate(steps, start, step, lambda s: F.sha2(s["held"], 256))).otherwise(leaf)


@dataclass
class Manifest:
    """leaves(tree, pos, size, digest, and what was carried), groups(tree, pos, size, digest, the group) and the nodes of both."""

    leaves: DataFrame
    groups: DataFrame
    nodes: DataFrame
    root: str | None
    fanout: int

    def proofs(self) -> DataFrame:
        """leaves with path, top_path, place and size of the group (top_pos, top_size) and subroot (hex)."""
        top = siblings(self.groups, self.nodes.where(F.col("tree") == TOP), self.fanout)
        top = self.groups.join(top.select(F.col("pos"), F.col("path").alias("top_path")), "pos", "left")
        top = materialise(top.select(F.col("pos").alias("tree"), F.col("pos").alias("top_pos"), F.col("size").alias("top_size"), "top_path", hexed("digest").alias("subroot")), "top")
        own = siblings(self.leaves, self.nodes.where(F.col("tree") != TOP), self.fanout)
        return self.leaves.join(own, ["tree", "pos"], "left").join(broadcast_few(top), "tree")


def manifest(docs: DataFrame, columns: list[str], group_col: str = "lang", order_col: str = "doc_id", fanout: int = 2, carry: dict[str, Column] | None = None) -> Manifest:
    """The trees over docs; `carry` names what else each leaf keeps, given over the columns of docs."""
    kept = carry or {}
    rows = distinct_names(docs).select(leaf_of([F.col(c) for c in columns]).alias("digest"), F.col(group_col).alias("_group"), F.col(order_col).alias("_order"), *[c.alias(k) for k, c in kept.items()])
    rows = materialise(rows, "leaves")
    own = materialise(placed(rows, ["_group"], [F.col("_order").asc_nulls_first(), F.col("digest")]), "placed")
    langs = materialise(own.select("_group").distinct(), "groups")
    langs = materialise(placed(langs, [], [F.col("_group").asc_nulls_first()]).select(F.col("_group").alias("_g"), F.col("_place").alias("tree")), "groups")
    own = own.join(broadcast_few(langs), F.col("_group").eqNullSafe(F.col("_g")))
    own = materialise(own.select("tree", F.col("_place").alias("pos"), F.col("_rows").alias("size"), "digest", "_order", *kept), "leaves")
    forest = grow(own, fanout)
    last = own.select("tree", depth_of(F.col("size"), fanout).alias("level")).distinct()
    roots = forest.join(last, ["tree", "level"])
    total = langs.count()
    groups = roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(total).cast("long").alias("size"), "digest")
    groups = materialise(groups, "groups")
    top = grow(groups, fanout)
    root = top.orderBy(F.desc("level")).select(hexed("digest")).first() if total else None
    return Manifest(own, groups, forest.unionByName(top), root[0] if root else None, fanout)


def proof_digest(path: Column, top_path: Column) -> Column:
    """Digest of the siblings, level by level to the root, left to right."""
    none = F.array().cast("array<struct<level:int,pos:bigint,digest:binary>>")
    both = F.concat(F.coalesce(path, none), F.coalesce(top_path, none))
    return F.sha2(F.array_join(F.transform(both, lambda x: hexed(x["digest"])), ""), 256)


def folded(leaf: Column, fanout: int) -> Column:
    """The root that `leaf` (hex) and the proof of its row, of Manifest.proofs, give."""
    sub = fold(leaf, F.col("pos"), F.col("size"), F.col("path"), fanout)
    return fold(sub, F.col("top_pos"), F.col("top_size"), F.col("top_path"), fanout)
