"""Quality rules with host verdicts, in DataFrame functions alone.

Row rules look at one text; host rules take the failures of all rows of a host (a column, here the source) and shrink the
failure rate by an empirical beta prior (method of moments over the hosts' rates, weighted by rows). A host is rejected if
its rate is surely bad for this corpus: if the posterior's lower bound (mean less `sure` deviations) is over a limit, which is
`factor` times the corpus's rate m, but m + `most` (1 - m) at most and `least` at least. So hosts that fail alike are all kept,
whatever they fail, and a host of few rows needs more of them to fail. A row stays if it passes its own base rules and its host isn't rejected.

Words are runs of characters other than space and 0x09-0x0D. Null text has no words, so it fails the base rules; a null
host is a host of its own; repeated rows count each; an empty table gives an empty result. Whole texts are read; no count
depends on row order. The columns added are _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words,
_base_failed, _host_rate (the posterior mean) and _kept; columns of these names are replaced. A very long text is one row's array of
words in the JVM, about 100 bytes a word.

Hosts are aggregated map-side, so a hot host is no hot task. Their verdicts are broadcast only when the table of hosts is
counted and has at most `broadcast_hosts` rows; beyond that the join shuffles and adaptive execution splits hot hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.keys import Shield
from rosterlake.tables import materialise

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
ADDED = ("_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "_base_failed", "_host_rate", "_kept")


def bound(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda over an array of one."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words in windows of `window` words that occur twice or more in the array. Windows are told apart by a 64-bit hash
    of their words' 64-bit hashes, within one text."""

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            def again(k: Column) -> Column:
                me = F.get(s, k)["h"]
                return F.coalesce(F.get(s, k - 1)["h"] == me, F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == me, F.lit(False))

            return F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), again), lambda k: F.get(s, k)["i"]))

        def length(p: Column) -> Column:
            step = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
            return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            bound(bound(pairs, positions), length)
        )

    def windows(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
        return F.when(F.size(w) <= window, F.lit(0).cast("long")).otherwise(bound(each, covered))

    return bound(F.transform(words, lambda x: F.xxhash64(x)), windows)


def row_metrics(df: DataFrame, text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_word = lambda x: F.length(F.translate(x, SPACES, "")) > 0
    lines = F.filter(F.split(text, "\n"), has_word)
    df = df.withColumn("_words", words_of(F.col(text_col)))
    return df.select(
        *[c for c in df.columns if c != "_words" and c not in ADDED],
        F.size("_words").cast("long").alias("_n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("_word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("_n_symbols"),
        bound(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long")).alias("_n_dup_lines"),
        repeated_words(F.col("_words")).alias("_n_repeat_words"),
    )


def with_base(df: DataFrame, min_words: int = 20, repeat_percent: int = 30) -> DataFrame:
    return df.withColumn("_base_failed", (F.col("_n_words") < min_words) | (100 * F.col("_n_repeat_words") > repeat_percent * F.col("_n_words")))


def host_verdicts(rows: DataFrame, host_col: str, factor: float = 5.0, least: float = 0.2, most: float = 0.4, sure: float = 3.0) -> DataFrame:
    """rows(host, _base_failed) -> (host, _host_rate, _host_ok): one row per host."""
    host = rows.groupBy(host_col).agg(F.count("*").alias("n"), F.sum(F.col("_base_failed").cast("long")).alias("f"))
    rate = F.col("f") / F.col("n")
    p = host.agg((F.sum("f") / F.sum("n")).alias("m"), (F.sum(F.col("n") * rate * rate) / F.sum("n")).alias("m2")).first()
    m = p["m"] or 0.0
    spread = (p["m2"] or 0.0) - m * m
    weight = min(1e6, max(1.0, m * (1 - m) / spread - 1)) if spread > 0 else 1e6
    mean = (F.col("f") + F.lit(m * weight)) / (F.col("n") + F.lit(weight))
    low = mean - F.lit(sure) * F.sqrt(mean * (1 - mean) / (F.col("n") + F.lit(weight + 1)))
    return host.select(host_col, mean.alias("_host_rate"), (low <= F.lit(max(least, min(factor * m, m + most * (1 - m))))).alias("_host_ok"))


def join_verdicts(rows: DataFrame, verdicts: DataFrame, host_col: str, broadcast_hosts: int = 100_000) -> DataFrame:
    """rows with _host_rate and _kept; a null host finds its own verdict."""
    v = verdicts.withColumnRenamed(host_col, "_host")
    small = verdicts.limit(broadcast_hosts + 1).count() <= broadcast_hosts
    joined = rows.join(F.broadcast(v) if small else v, F.col(host_col).eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("_kept", ~F.col("_base_failed") & F.col("_host_ok")).drop("_host_ok")


def quality_rules(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", host_col: str = "source", **limits: float) -> DataFrame:
    """Metrics and verdict of each row: the id, the host and the columns named above, without the text."""
    rows = row_metrics(docs.select(id_col, host_col, text_col), text_col).drop(text_col)
    rows = materialise(with_base(rows), "rules")
    hosts = materialise(host_verdicts(rows, host_col, **limits), "hosts")
    return join_verdicts(rows, hosts, host_col)


def quality_filter(docs: DataFrame, text_col: str = "text", host_col: str = "source", **limits: float) -> DataFrame:
    """docs without the rows that the rules or their host's verdict reject; texts aren't shuffled."""
    shield = Shield(docs, text_col)
    host = shield.of(host_col)
    marked = materialise(with_base(row_metrics(shield.df)).select(*shield.own, "_base_failed"), "marked")
    hosts = materialise(host_verdicts(marked, host, **limits), "hosts")
    return shield.restore(join_verdicts(marked, hosts, host).where("_kept"))
