"""Resampling towards a target distribution by hashed features.

Features are runs of 1 to `ngrams` words joined by a space, words being runs of letters a-z (A-Z in lower case), digits and all
beyond ASCII; a feature's bucket is its CRC-32 modulo `buckets`. How much likelier a bucket is in the target than in the corpus is its gain,
a whole number of thousandths; a row's weight is the sum over its features, and a keyed Gumbel value added to it
makes the greatest scores a sample without replacement.

Each text is read once: higher-order functions make its array of buckets, which is kept in a table. The corpus's counts are
summed over that table, so only totals of buckets shuffle, `buckets` rows a task at most, and reach the driver, `buckets` rows in all. Gains
go back as one literal array, and a weight is a sum of element_at over the row's own array: no row is exploded to be scored. The
draw orders (score, id) by Spark's sampled splitters.

Nulls: a null text has no features and weight 0; a null id takes part, its key being the empty string, and comes last in ties. Rows of equal id
have the same noise and a rank each. Texts are read whole; a row's array takes 2 bytes a feature. An empty table gives an empty
result; without a target text every t is 0. The columns added are _n_features, _weight, _score and _rank (null if not drawn); columns of these
names are replaced, others come back under their names. The text is not carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.keys import Shield
from rosterlake.llm.order import placed
from rosterlake.tables import forget, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ADDED = ("_n_features", "_weight", "_score", "_rank")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def bucket_array(words: Column, ngrams: int, buckets: int) -> Column:
    """The bucket of every feature of an array of words."""

    def bucket(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % buckets).cast("int")

    def runs(n: int) -> Column:
        if n == 1:
            return F.transform(words, bucket)
        starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: bucket(F.array_join(F.slice(words, i, n), " ")))).otherwise(F.array().cast("array<int>"))

    return F.concat(*[runs(n) for n in range(1, ngrams + 1)]) if ngrams > 1 else runs(1)


def featured(df: DataFrame, ngrams: int, buckets: int) -> DataFrame:
    """df, its `text` replaced by _words (how many) and _buckets."""
    own = df.withColumn("_list", words_of(F.col("text")))
    return own.select(*[c for c in df.columns if c != "text"], F.size("_list").cast("long").alias("_words"), bucket_array(F.col("_list"), ngrams, buckets).alias("_buckets"))


def bucket_counts(rows: DataFrame) -> dict[int, int]:
    """Features of each bucket that has one; at most a row a bucket reaches the driver."""
    got = rows.select(F.explode("_buckets").alias("b")).groupBy("b").count().collect()
    return {r["b"]: r["count"] for r in got}


def gains_of(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    s, t = sum(corpus.values()), sum(target.values())
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * (s + buckets) / ((corpus.get(b, 0) + 1) * (t + buckets)))) for b in range(buckets)]


def weight_of(buckets: Column, gains: list[int]) -> Column:
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")  # folded into one literal
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, b + 1))


def noise_of(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of the SHA-256 of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, text_col: str = "text", id_col: str = "doc_id", target_col: str = "text", ngrams: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """docs without the text, with the columns named above: of the rows with `least_words` words, `percent` in a hundred are drawn."""
    shield = Shield(docs, text_col, id_col)
    carried = [c for c in shield.own if c != "text"]
    made = materialise(featured(shield.df, ngrams, buckets), "buckets")
    wanted = bucket_counts(featured(Shield(target, target_col).df.select("text"), ngrams, buckets))
    gains = gains_of(bucket_counts(made), wanted, buckets)
    rows = made.select(*carried, F.size("_buckets").cast("long").alias("_n_features"), weight_of(F.col("_buckets"), gains).alias("_weight"), (F.col("_words") >= least_words).alias("_fit"))
    rows = materialise(rows.withColumn("_score", F.col("_weight") + noise_of(F.col(shield.id), seed)), "scores")
    draws = rows.where("_fit").count() * percent // 100
    forget(made)
    by = [F.desc("_fit"), F.desc("_score"), F.col(shield.id).asc_nulls_last(), F.col("_n_features"), F.col("_weight")]
    rank = F.when(F.col("_place") < draws, F.col("_place") + 1).cast("long")
    out = placed(rows, [], by).withColumn("_rank", rank)
    kept = [(c, n) for c, n in zip(shield.own, shield.names) if c != "text" and n not in ADDED]
    return out.select(*[F.col(c).alias(n) for c, n in kept], *ADDED)
