"""Connected components by alternating star contraction, all of it distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.tables import materialise


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(u, v) of any orderable type -> (node, root), root the least node reachable; nodes without an edge are
    absent. Each round replaces edges by edges to smaller nodes; a hub is aggregated map-side and its join is
    one that adaptive execution can split. Nulls and loops are ignored; empty in, empty out."""
    now = materialise(edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).select("u", "v").distinct(), "edges")
    for _ in range(rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = materialise(large.distinct(), "large")
        lower = down.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        target = lower.groupBy("u").agg(F.min("v").alias("m"))
        small = lower.join(target, "u")
        after = materialise(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(target.select("u", F.col("m").alias("v"))).distinct(), "small"
        )
        # a star forest: no node is both a leaf and a centre, and every leaf has one centre
        centres = after.select(F.col("v").alias("u")).distinct()
        stars = after.join(centres, "u", "left_semi").limit(1).count() == 0 and after.groupBy("u").count().where("count > 1").limit(1).count() == 0
        now = after
        if stars:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
