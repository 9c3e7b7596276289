"""Places of rows in an order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.tables import materialise

#: Rows of a side that is broadcast; counted each time, and joined by a shuffle beyond it.
FEW = 100_000


def broadcast_few(side: DataFrame, few: int = FEW) -> DataFrame:
    """side (a table), marked for broadcast if it has at most `few` rows."""
    return F.broadcast(side) if side.limit(few + 1).count() <= few else side


def placed(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """rows (a table) with _place, from 0 within equal values of the columns `group`, and _rows, how many there are. Null
    is a value and comes first; strings compare bytewise. Rows of equal group and order come in any order, but are dealt over
    partitions like others, so neither a hot group nor a hot row is a hot task.

    Spark's sampled splitters deal the rows into ranges; a place is that in the range plus the counts of the ranges before, of
    which there is a row a group and partition."""
    keys = [F.col(g).asc_nulls_first() for g in group] + order
    own = rows.withColumn("_tie", F.monotonically_increasing_id())
    own = materialise(own, "tied")
    run = own.repartitionByRange(*keys, F.col("_tie")).sortWithinPartitions(*keys, F.col("_tie"))
    run = materialise(run.drop("_tie").withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33).cast("int")), "ordered")
    part = run.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_held"))
    every = Window.partitionBy(*(group or [F.lit(0)]))
    before = F.coalesce(F.sum("_held").over(every.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_r"), (before - F.col("_first")).alias("_shift"), F.sum("_held").over(every).alias("_rows"))
    part = materialise(part, "ranges")
    match = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        match &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = run.join(broadcast_few(part), match)
    return out.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("_place"), "_rows")
