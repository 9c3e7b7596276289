"""opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.tables import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rosterlake.llm.suffix_dedup import suffix_dedup

    out = suffix_dedup(table(spark, sf_dir, "documents"))
    size = F.coalesce(F.octet_length(F.col("text").cast("binary")), F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.octet_length("_kept").cast("long")).alias("n_removed"),
        F.size("_spans").cast("long").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


def _crc(column: str, divisor: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def op2_lang_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rosterlake.llm import lang_crf

    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(_crc("doc_id", 4) == 2, F.lit(False))
    tagger = lang_crf.fit(docs, ~held)
    out = lang_crf.identify(docs.select("doc_id", held.alias("held_out"), "text"), tagger)
    return out.select("doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_lang_score").alias("score"))


def op3_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rosterlake.llm.phrase_dedup import phrase_dedup

    out = phrase_dedup(table(spark, sf_dir, "documents"))
    gone = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", F.col("_words").alias("n_words"), gone.alias("n_removed"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rosterlake.llm.simhash import simhash_components

    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))


def op5_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rosterlake.llm.piece_dropout import decode, encode

    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = decode(rows)
    same = F.col("_decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", F.size("_pieces").cast("long").alias("n_pieces"), F.col("_pieces").alias("pieces"), same.alias("lossless"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rosterlake.llm.quality_rules import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *[F.col(f"_{c}").alias(c) for c in names], F.round("_host_rate", 6).alias("host_rate"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rosterlake.llm.mixing import mix

    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_place").alias("place"))


def op7_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rosterlake.llm.reply_trees import format_conversations, read_back

    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    out = format_conversations(rows.union(extra))
    return out.select("conv", "formatted", "loss").mapInArrow(read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_partition_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rosterlake.llm.partition_search import partition_search

    return partition_search(table(spark, sf_dir, "embeddings"))


def op10_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rosterlake.llm import quality_knn

    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    held = F.coalesce(_crc("doc_id", 3) == 1, F.lit(False))
    voter = quality_knn.fit(docs, labels, ~held)
    out = quality_knn.score_quality(docs.select("doc_id", held.alias("held_out"), "text"), voter)
    return out.select("doc_id", "held_out", F.col("_quality").alias("score"), F.when(F.col("_quality") >= 0.5, 1).otherwise(0).alias("predicted"))


def op11_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rosterlake.llm.merkle import folded, hexed, leaf_of, manifest, proof_digest

    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    altered = leaf_of([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in columns])
    made = manifest(table(spark, sf_dir, "documents"), columns, carry={"doc_id": F.col("doc_id"), "altered": F.when(_crc("doc_id", 7) == 0, altered)})
    root = F.lit(made.root).cast("string")
    out = made.proofs().select("*", folded(hexed(F.coalesce("altered", "digest")), made.fanout).alias("folded_root"))
    return out.select(
        "doc_id", hexed("digest").alias("leaf"), "subroot", root.alias("root"), proof_digest(F.col("path"), F.col("top_path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified")
    )


def op12_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rosterlake.llm.importance import resample

    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", *[F.col(f"_{c}").alias(c) for c in ("n_features", "weight", "score", "rank")])


def op13_lattice_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rosterlake.llm.lattice_dedup import lattice_links

    out = lattice_links(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", F.col("_links").alias("n_links"), F.col("_component").alias("component_id"), (F.col("vec_id").eqNullSafe(F.col("_component"))).alias("kept"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from rosterlake.llm import sql

    return sql.oracles()
