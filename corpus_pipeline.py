"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again.

quality rules -> SimHash near-dedup (verified) -> suffix-array dedup -> mixing to target weights -> SentencePiece encoding. All stages
but the last return the columns of documents; n_chars follows the text. Every stage takes an empty table and columns besides those
of documents, which it leaves out; very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.mixing import mix
from rosterlake.llm.near_dedup import near_keep_one
from rosterlake.llm.piece_dropout import encode
from rosterlake.llm.quality_rules import quality_filter
from rosterlake.llm.suffix_dedup import suffix_dedup
from rosterlake.session import ship
from rosterlake.tables import materialise, table

#: Bytes of a repeated passage that the suffix stage cuts: fifty words of three letters and a space each are no shorter.
PASSAGE = 200
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail their base rules, or whose source is rejected as a whole, go: null, blank and short texts among them.
    Repeated rows are judged alike; a null source is a source."""
    ship(spark)
    return quality_filter(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of the least id stays, of equal ids that of the least text hash, of repeated rows
    one. Near copies have a Jaccard similarity of 0.8 or more over word shingles of five; SimHash and MinHash find candidates, the
    shingle sets themselves decide. Null and blank texts are copies of each other; a null id is the greatest."""
    ship(spark)
    return near_keep_one(docs, shingle=5, least=0.8).select(*COLUMNS)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Characters that lie wholly in a repeated run of PASSAGE bytes are cut; a row stays even if nothing is left of it, and a
    null text stays null. Repeated rows are copies of each other and lose all that is long enough."""
    ship(spark)
    out = suffix_dedup(docs.select(*COLUMNS), min_bytes=PASSAGE, with_text=True)
    cut = F.size("_spans") > 0
    text = F.when(cut, F.col("_kept_text")).otherwise(F.col("text"))
    return out.select("doc_id", text.alias("text"), "lang", "source", F.when(cut, F.length("_kept_text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is read once at least and twice at most, the smaller the more often; nothing is dropped. A null text weighs
    nothing, a null source is a source, repeated rows are read alike."""
    ship(spark)
    return mix(docs, max_repeats=2.0, budget="cover").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each text, by seeded merge-dropout; none of a null or empty text."""
    ship(spark)
    out = encode(docs)
    return out.select("doc_id", "lang", "source", F.size("_pieces").cast("long").alias("n_pieces"), F.col("_pieces").alias("pieces"))


STAGES = [
    ("quality rules", quality),
    ("near dedup", near_dedup),
    ("suffix dedup", repeated_text),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: Fingerprints, hashes of blocks and pieces have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, "stage")
    return docs
