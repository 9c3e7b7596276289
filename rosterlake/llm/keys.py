"""Row keys: a document is told apart by its id and the hash of its text, so repeated ids and repeated rows join
back to rows with equal results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST = (1 << 63) - 1


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds _id (the id; a null is the greatest) and _th (a hash of the text)."""
    return df.withColumn("_id", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))).withColumn("_th", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))


def null_last(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(LAST))


class Shield:
    """A frame whose columns have been numbered, so that no name of the caller's, repeated ones included, meets a name of
    the operator's. The text column is `text`, and is not carried twice."""

    def __init__(self, df: DataFrame, text_col: str = "text", id_col: str | None = None):
        self.names = df.columns
        place = lambda name: next(i for i, c in enumerate(self.names) if c == name)
        self.own = [f"c{i}_" for i in range(len(self.names))]
        self.own[place(text_col)] = "text"
        self.df = df.toDF(*self.own)
        self.id = self.own[place(id_col)] if id_col else None
        self.of = lambda name: self.own[place(name)]

    def keyed(self) -> DataFrame:
        return keyed(self.df, self.id, "text")

    def restore(self, out: DataFrame, *added: str) -> DataFrame:
        """The caller's columns under their names, then those added; an added name replaces one of the caller's."""
        return out.select(*[F.col(c).alias(n) for c, n in zip(self.own, self.names) if n not in added], *added)


def distinct_names(df: DataFrame) -> DataFrame:
    """df with the first of all columns whose names are equal but for case."""
    names = [c.lower() for c in df.columns]
    own = df.toDF(*[f"c{i}_" for i in range(len(names))])
    return own.select(*[F.col(f"c{i}_").alias(df.columns[i]) for i, c in enumerate(names) if names.index(c) == i])


def schema_of(df: DataFrame, *but: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in but)


def bounded_sample(rows: DataFrame, on: list[str], size: int, of: int) -> DataFrame:
    """The `size` rows of least hash of `on`, of about `of` rows. A share of the hashes that holds about twice as many is
    picked first, so what tasks send to the driver stays bounded however many tasks there are."""
    h = F.xxhash64(*[F.col(c) for c in on])
    if of > 2 * size:
        rows = rows.where(F.pmod(h, F.lit(1 << 40)) < F.lit(int((1 << 40) * 2 * size / of)))
    return rows.orderBy(F.pmod(h, F.lit(1 << 40)), *on).limit(size)


def join_hot(rows: DataFrame, side: DataFrame, on: list[str], how: str, count: str = "c", hot: int = 4096, few: int = 20_000) -> DataFrame:
    """rows (a table) joined, inner or left_semi, with side (a table, one row a key, `count` the key's rows): the keys of more than
    `hot` rows are broadcast where they are `few` at most, counted here, so none of them becomes a task; the rest is shuffled."""
    large = side.where(F.col(count) > hot).drop(count)
    if not 0 < large.limit(few + 1).count() <= few:
        return rows.join(side.drop(count), on, how)
    rest = rows.join(F.broadcast(large.select(*on)), on, "left_anti").join(side.where(F.col(count) <= hot).drop(count), on, how)
    return rows.join(F.broadcast(large), on, how).unionByName(rest)
