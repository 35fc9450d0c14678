"""Registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelake.llm import byte_dedup, conversation_repair, disclosure, hard_negatives, katz_backoff, language_id, ngram_join, phrase_index, quality_divergence, shuffle_matrix, source_mix, substring_dedup, tag_paths


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and the smallest id it is linked to."""
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"))


def op2_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    return language_id.identified(_table(spark, sf_dir, "documents"))


def op3_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark windows of ten words cover, and whose windows they are."""
    rows = phrase_index.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", F.col("n_words"), "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def op4_block_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of the sources takes."""
    rows = source_mix.mixed_words(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                       F.col("_target").alias("target"), F.col("_taken").cast("long").alias("taken"))


def op5_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    rows = tag_paths.extracted(_table(spark, sf_dir, "pages"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op6_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and whether the divergence rule keeps it."""
    rows = quality_divergence.judged(_table(spark, sf_dir, "documents"), ["doc_id"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the terms that disclose it."""
    return disclosure.digests(disclosure.personal_data(_table(spark, sf_dir, "documents")))


def op8_communication_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 24 and its place there."""
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shuffle_matrix.shuffled(rows, 24, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's log probability of every document, learned from those that are not held out."""
    return katz_backoff.scored(_table(spark, sf_dir, "documents"), language_id.held_out(F.col("doc_id"), 5))


def op10_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that a document with a smaller id has in a window of 50, and the digest of the rest."""
    rows = substring_dedup.deduplicated(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_four_russians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every conversation after damage, and the cheapest edits that repair its roles."""
    return conversation_repair.audited(conversation_repair.damaged(_table(spark, sf_dir, "conversations")))


def op12_bucket_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a string of 100 bytes repeats from earlier on, and the digest of the rest."""
    rows = byte_dedup.deduplicated(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op13_hilbert_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, for each of its first five positives."""
    rows = hard_negatives.relabelled(hard_negatives.prepared(_table(spark, sf_dir, "embeddings")))
    return hard_negatives.mined(rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_naive_bayes": op2_naive_bayes,
    "op3_phrase_index": op3_phrase_index,
    "op4_block_mix": op4_block_mix,
    "op5_tag_paths": op5_tag_paths,
    "op6_distribution_divergence": op6_distribution_divergence,
    "op7_disclosure": op7_disclosure,
    "op8_communication_matrix": op8_communication_matrix,
    "op9_katz_backoff": op9_katz_backoff,
    "op10_suffix_automata": op10_suffix_automata,
    "op11_four_russians": op11_four_russians,
    "op12_bucket_pointers": op12_bucket_pointers,
    "op13_hilbert_zones": op13_hilbert_zones,
}
