"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, factorisation, language, merkle, near_dup, packing, pii, prefix_trie, quality, sharding, suffix_dedup, tokens
from ._common import shared_folder, table

#: Where the vocabulary files of the public tokenizers lie, unless a caller says otherwise.
BYTE_BPE_JSON, BYTE_BPE_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Key of the pseudonyms in the registered query; a deployment passes its own secret.
PSEUDONYM_KEY = "registered-query"
OVER_LIMIT = 512


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache folder of its own, so each run encodes every distinct text."""
    cache = f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    found = tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE_JSON), cache)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > OVER_LIMIT).alias("over_limit"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identified(docs, language.trained(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), F.col("language").alias("lang_pred"), "score", "rejected")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def token_lengths(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return tokens.encoded(docs.select("doc_id", "text"), tokenizer_path(BYTE_BPE_RANKS), pattern=public_tokenizers.PATTERN)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(token_lengths(table(spark, sf_dir, "documents")))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(table(spark, sf_dir, "conversations"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY, found_col="found")
    return found.select("doc_id", "text", F.size("found").cast("long").alias("n_replaced"), F.transform("found", lambda x: x["kind"]).alias("kinds"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorisation.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.verified(table(spark, sf_dir, "documents"), tampered=changed)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_language_id, op3_quality_rules, op4_packing, op5_benchmark_decontamination,
        op6_simhash_near_dedup, op7_chat_formatting, op8_pii, op9_sharding, op10_suffix_array_dedup,
        op11_quality_classifier, op12_merkle_manifest, op13_prefix_trie,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": quality.JUDGED_SQL,
    "op5_benchmark_decontamination": decontaminate.CONTAMINATION_SQL,
    "op7_chat_formatting": chat.ROTATED_SQL,
    "op10_suffix_array_dedup": suffix_dedup.DEDUP_SQL,
    "op12_merkle_manifest": merkle.VERIFIED_SQL,
    "op13_prefix_trie": prefix_trie.TRIE_SQL,
}
