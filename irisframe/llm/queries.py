"""The registered queries of the document operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from irisframe.llm import align, bpe, host_rules, line_dedup, media, minhash, packing, ring, simhash, substring, suffix_dedup, warc, whitening
from irisframe.llm.common import stored
from irisframe.session import scratch_dir

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = host_rules.judge(_documents(spark, folder), payload=["doc_id"])
    return rows.select(
        F.col("_in.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = suffix_dedup.cut_repeats(_documents(spark, folder))
    return rows.select(
        F.col("_in.doc_id").alias("doc_id"),
        F.col("_n_bytes").alias("n_bytes"),
        F.col("_n_removed").alias("n_removed"),
        F.col("_n_spans").alias("n_spans"),
        F.sha2("_kept", 256).alias("kept_sha256"),
    )


def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.judge(_documents(spark, folder).select("doc_id", "text")).select(
        F.col("_in.doc_id").alias("doc_id"), F.col("_n_shingles").alias("n_shingles"), F.col("_component_id").alias("component_id"), F.col("_kept").alias("kept")
    )


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = substring.cut_passages(_documents(spark, folder))
    return rows.select(
        F.col("_in.doc_id").alias("doc_id"), F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept_sha256").alias("kept_sha256")
    )


def op5_media_columns(spark: SparkSession, folder: str) -> DataFrame:
    files = stored(media.stored_texts(_documents(spark, folder)), "media-files")
    return media.media_digests(files)


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_documents(spark, folder), VOCABULARY)


def op7_warc_segments(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_dir(spark, "warc")
    warc.write_archives(spark.read.parquet(f"{folder}/pages.parquet"), path)
    return warc.page_payloads(spark, path).drop("reason")


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = line_dedup.cut_boilerplate(_documents(spark, folder))
    return rows.select(
        F.col("_in.doc_id").alias("doc_id"), F.col("_cut").alias("n_removed_lines"), F.sha2(F.coalesce("_text", F.lit("")), 256).alias("kept_sha256")
    )


def op9_ring_shards(spark: SparkSession, folder: str) -> DataFrame:
    return ring.shard_documents(_documents(spark, folder))


def op10_recursive_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, folder), RANKS, public_tokenizers.PATTERN)


def op11_cross_tokenizer(spark: SparkSession, folder: str) -> DataFrame:
    return align.align_documents(_documents(spark, folder), VOCABULARY, PIECES).documents


def op12_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, folder))


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{folder}/embeddings.parquet"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_media_columns": op5_media_columns,
    "op6_packing": op6_packing,
    "op7_warc_segments": op7_warc_segments,
    "op8_line_dedup": op8_line_dedup,
    "op9_ring_shards": op9_ring_shards,
    "op10_recursive_bpe": op10_recursive_bpe,
    "op11_cross_tokenizer": op11_cross_tokenizer,
    "op12_simhash_near_dedup": op12_simhash_near_dedup,
    "op13_embedding_whitening": op13_embedding_whitening,
}
