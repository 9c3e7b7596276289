"""Mixing sources to target weights, in DataFrame functions alone.

Weights are token shares to the power of an exponent between 0 (uniform) and 1 (as they are), normalised. The exponent is
bisected (in rounds of `grid` candidates, all evaluated in one aggregation over the sources) to meet either

  target_entropy   the least exponent whose weights have no more than that entropy (nats), or
  max_repeats      the least exponent at which no source is read more often than that.

The budget of tokens is a number, or "cover": the least that reads every source once at least, so that mixing drops
no document. A source's share of it is read as whole passes and a part of one. Documents lie in blocks by a keyed hash of
their id and text; each pass permutes the blocks by another key, a part takes whole blocks while they fit, and of the next
block the documents, in permuted order, that fit. So no order over a whole source is needed: a hot source is many blocks,
block sums are pre-aggregated, and what comes before a block is summed in two steps, over ranges of the order and within one, so no
task has a source's blocks.

Tokens are words here. Null text has none: it weighs nothing and goes with its block. A null source is a source of its own;
repeated rows are copies with the same place; a null id hashes like any value; an empty table gives an empty result. A source
without tokens gets one pass. Added: _tokens, _epoch (0 first), _block and _place (order by these for the mixture).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.llm.keys import Shield
from rosterlake.llm.quality_rules import word_count
from rosterlake.tables import materialise

BLOCK = 1024
#: Blocks of a source whose running sum is one task's; a source has as many such ranges of its order as it needs.
RANGE = 4096


def exponent(totals: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | str = "cover", grid: int = 32, rounds: int = 9) -> float:
    """totals(t: tokens of a source, over 0). Entropy falls and repeats fall as the exponent rises, so both are met
    from some exponent on; 1 if not even that meets them."""
    if target_entropy is None and max_repeats is None:
        return 1.0
    low, high = 0.0, 1.0
    whole = totals.agg(F.sum("t").alias("t"), F.max("t").alias("most"), F.min("t").alias("least")).first()
    if not whole or not whole["t"]:
        return 1.0
    for _ in range(rounds):
        step = (high - low) / grid
        tried = totals.select(F.col("t") / F.lit(float(whole["t"])), F.explode(F.array(*[F.lit(low + step * k) for k in range(grid + 1)]))).toDF("p", "a")
        z = tried.groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("l")).orderBy("a").collect()
        met = high
        for r in reversed(z):
            a = r["a"]
            if target_entropy is not None:
                ok = math.log(r["z"]) - a * r["l"] / r["z"] <= target_entropy + 1e-12
            else:
                share = whole["least"] / whole["t"] if a < 1 else whole["most"] / whole["t"]
                if budget == "cover":
                    reads = (whole["most"] / whole["least"]) ** (1 - a)
                else:
                    reads = float(budget) / whole["t"] * share ** (a - 1) / r["z"]
                ok = reads <= max_repeats + 1e-12
            if not ok:
                break
            met = a
        low, high = max(low, met - step), met
        if high <= low:
            break
    return high


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", target_entropy: float | None = None, max_repeats: float | None = 2.0, budget: float | str = "cover", seed: int = 17, block: int = BLOCK) -> DataFrame:
    """docs as the mixture reads them: a row for each reading, with the columns named above."""
    shield = Shield(docs, text_col, id_col)
    names, source_col = shield.own, shield.of(source_col)
    key = F.xxhash64(F.lit(seed), F.col(shield.id).cast("string"), F.coalesce("text", F.lit("")))
    rows = shield.df.select(*names, word_count(F.col("text")).alias("_tokens"), key.alias("_key"))
    plan_rows = materialise(rows.select(F.col(source_col).alias("_s"), "_tokens", "_key"), "tokens")
    totals = materialise(plan_rows.groupBy("_s").agg(F.sum("_tokens").alias("t"), F.count("*").alias("n")), "sources")
    a = exponent(totals.where("t > 0"), target_entropy, max_repeats, budget)
    share = totals.where("t > 0").agg(F.sum(F.pow("t", F.lit(a))).alias("z"), F.max(F.pow("t", F.lit(1 - a))).alias("cover")).first()
    z = share["z"] or 1.0
    # tokens of a source = budget * t**a / z; covering all needs budget >= z * t**(1 - a) for each
    wanted = (share["cover"] or 0.0) * z if budget == "cover" else float(budget)
    target = F.lit(wanted) * F.pow("t", F.lit(a)) / F.lit(z)
    source = totals.select("_s", F.ceil(F.col("n") / block).cast("long").alias("blocks"), "t", F.when(F.col("t") > 0, target).otherwise(F.lit(0.0)).alias("target"))
    # the smallest share of a token is forgiven, so that a source meant to be read once is read whole
    passes = F.when(F.col("t") > 0, F.floor(F.col("target") / F.col("t") + 1e-9)).otherwise(F.lit(1)).cast("long")
    source = source.withColumn("passes", passes).withColumn("left", F.greatest(F.lit(0).cast("long"), F.floor(F.col("target") - F.col("passes") * F.col("t") + 1e-6).cast("long")))
    source = materialise(source.select("_s", "blocks", "passes", "left"), "plan")

    few = source.limit(100_001).count() <= 100_000  # counted, so the broadcast is bounded

    def with_source(df: DataFrame, on: str) -> DataFrame:
        side = source.withColumnRenamed("_s", "_of")
        return df.join(F.broadcast(side) if few else side, F.col(on).eqNullSafe(F.col("_of"))).drop("_of")

    dealt = with_source(plan_rows, "_s").withColumn("_block", F.pmod("_key", "blocks"))
    sums = dealt.groupBy("_s", "_block").agg(F.sum("_tokens").alias("t"), F.first("passes").alias("passes"), F.first("left").alias("left"), F.first("blocks").alias("blocks"))
    # tokens before a block in the pass's order: those of the ranges of the order before its own, and of its own range before it
    turn_of = F.xxhash64(F.lit(seed), F.col("passes"), F.col("_block"))
    ranges = F.ceil(F.col("blocks") / RANGE).cast("long")
    sums = sums.withColumn("_turn", turn_of).withColumn("_range", F.floor((F.col("_turn") / F.lit(2.0**64) + 0.5) * ranges).cast("long"))
    sums = materialise(sums, "blocks")
    earlier = Window.partitionBy("_s").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.groupBy("_s", "_range").agg(F.sum("t").alias("t")).select(F.col("_s").alias("_of"), F.col("_range").alias("_r"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("_start"))
    starts = materialise(starts, "ranges")
    within = Window.partitionBy("_s", "_range").orderBy("_turn", "_block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_start") + F.coalesce(F.sum("t").over(within), F.lit(0))
    room = F.greatest(F.lit(0).cast("long"), F.least("t", F.col("left") - before))
    few_ranges = starts.limit(100_001).count() <= 100_000
    ranged = sums.join(F.broadcast(starts) if few_ranges else starts, F.col("_s").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_r")))
    placed = materialise(ranged.select("_s", "_block", "passes", "t", room.alias("room")), "blocks")
    # one block a source at most is cut: its documents, in permuted order, up to the last that fits
    turn = F.xxhash64(F.col("passes"), F.col("_key"))
    cut = placed.where("room > 0 and room < t").select(F.col("_s").alias("_of"), F.col("_block").alias("_b"), "room")
    inside = Window.partitionBy("_of", "_b").orderBy("turn", "_key")
    fits = dealt.join(cut, F.col("_s").eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_b"))).select("_of", "_b", "room", "_key", "_tokens", turn.alias("turn"))
    fits = fits.groupBy("_of", "_b", "room", "_key", "turn").agg(F.sum("_tokens").alias("_tokens"))  # repeated rows go together
    fits = fits.withColumn("_run", F.sum("_tokens").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))).where("_run <= room")
    edge = fits.groupBy("_of", "_b").agg(F.max(F.struct("turn", "_key")).alias("edge"))
    plan = placed.join(edge, F.col("_s").eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_b")), "left")
    plan = materialise(plan.select(F.col("_s").alias("_of"), F.col("_block").alias("_b"), "passes", F.when((F.col("room") > 0) & (F.col("room") == F.col("t")), 1).otherwise(0).alias("whole"), "edge"), "reading")
    few_blocks = plan.limit(100_001).count() <= 100_000

    home = source.select(F.col("_s").alias("_of0"), "blocks")
    out = rows.join(F.broadcast(home) if few else home, F.col(source_col).eqNullSafe(F.col("_of0"))).withColumn("_block", F.pmod("_key", "blocks"))
    out = out.join(F.broadcast(plan) if few_blocks else plan, F.col(source_col).eqNullSafe(F.col("_of")) & (F.col("_block") == F.col("_b")))
    partly = F.coalesce(F.struct(turn.alias("turn"), F.col("_key")) <= F.col("edge"), F.lit(False)).cast("int")
    readings = F.col("passes") + F.col("whole") + partly
    out = out.withColumn("_n", readings).where("_n > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    place = F.xxhash64(F.lit(seed), F.col("_epoch"), F.col("_block"), F.col("_key"))
    out = out.select(*names, "_tokens", F.col("_epoch").cast("int").alias("_epoch"), "_block", place.alias("_place"))
    return shield.restore(out, "_tokens", "_epoch", "_block", "_place")
