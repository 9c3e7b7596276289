"""Record search by trigrams: what a needle rules out isn't read.

An index over rows holds their trigrams in three tables: how many rows have each gram, which rows those are, and the rows themselves, the last two in
buckets by hash and sorted, so that a reader prunes by folder and by the statistics in the files. A search looks at the counts of the
needle's grams, reads the postings of the rarest, keeps the keys that have them all, reads the buckets those fall into, and checks
each row by the needle itself. Needles of under three characters, which no gram can help, scan the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions.text import cell

GRAM = 3


def grams(values: Column) -> Column:
    """Different trigrams of an array of strings; none reaches over two values."""

    def of(v: Column) -> Column:
        return F.when(F.length(v) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(v) - (GRAM - 1)), lambda i: F.substring(v, i, GRAM))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(values, of)))


def _bucket(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


class SearchIndex:
    """An index in a folder. Rows need a key that is theirs alone; the columns searched are all, or those named when it is built."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.json(f"{self.path}/about").first()
        self.buckets, self.key, self.columns = about["buckets"], about["key"], list(about["columns"])

    @classmethod
    def build(cls, rows: DataFrame, path: str, key: str = "key", columns: list[str] | None = None, buckets: int = 64) -> SearchIndex:
        spark, path, kinds = rows.sparkSession, path.rstrip("/"), dict(rows.dtypes)
        low = F.array(*[F.lower(cell(F.col(c), kinds[c])) for c in columns or rows.columns])
        kept = rows.withColumn("_values", F.array_compact(low)).withColumn("_bucket", _bucket(F.col(key), buckets))
        kept.repartition("_bucket").sortWithinPartitions("_bucket", key).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/rows")
        stored = spark.read.parquet(f"{path}/rows")
        each = stored.select(F.explode(grams(F.col("_values"))).alias("gram"), key)
        each.groupBy("gram").agg(F.count("*").alias("n")).sort("gram").write.mode("overwrite").parquet(f"{path}/grams")
        # a frequent gram is spread over the tasks that write its bucket
        spread = each.withColumn("_bucket", _bucket(F.col("gram"), buckets)).repartition("_bucket", _bucket(F.col(key), 8))
        spread.sortWithinPartitions("_bucket", "gram").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/postings")
        about = spark.createDataFrame([(buckets, key, rows.columns)], "buckets int, key string, columns array<string>")
        about.coalesce(1).write.mode("overwrite").json(f"{path}/about")
        return cls(spark, path)

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def search(self, needle: str, rarest: int = 4) -> DataFrame:
        """Rows with the needle in a value, whatever case."""
        low = needle.lower()
        holds = F.exists("_values", lambda v: F.contains(v, F.lit(low)))
        if len(low) < GRAM:
            return self._rows().where(holds).select(*self.columns)
        asked = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
        known = {r["gram"]: r["n"] for r in self.spark.read.parquet(f"{self.path}/grams").where(F.col("gram").isin(asked)).collect()}  # a row a gram of the needle at most
        if len(known) < len(asked):
            return self._rows().where("false").select(*self.columns)
        best = sorted(asked, key=lambda g: (known[g], g))[:rarest]
        at = [r[0] for r in self.spark.range(1).select(F.explode(F.array_distinct(F.array(*[_bucket(F.lit(g), self.buckets) for g in best])))).collect()]
        post = self.spark.read.parquet(f"{self.path}/postings").where(F.col("_bucket").isin(at) & F.col("gram").isin(best))
        hits = post.groupBy(self.key).agg(F.count("*").alias("n")).where(F.col("n") == len(best)).select(self.key)
        folders = [r[0] for r in hits.select(_bucket(F.col(self.key), self.buckets)).distinct().collect()]  # bucket numbers
        return self._rows().where(F.col("_bucket").isin(folders) & holds).join(hits, self.key, "left_semi").select(*self.columns)
