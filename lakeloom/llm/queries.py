"""The operators' queries over whole tables and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import bpe, embedding_dedup, line_dedup, lm_scoring, merkle, mixing, ngram_join, quality_classifier, quality_rules, secrets, suffix_dedup, toxicity, whitening
from lakeloom.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, ids=False, decoded=False)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(found, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return s.select(
        "doc_id", *counts,
        F.sha2(secrets.spans_text(F.col("found")), 256).alias("base_sha256"),
        secrets.spans_text(F.array_sort(F.concat("found", "added"))).alias("spans"),
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), with_bytes=False)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merkle.manifest(table(spark, sf_dir, "documents"), claimed=merkle.without_line_ends())
    return m.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {"op1_toxicity": op1_toxicity, "op2_bpe": op2_bpe, "op3_ngram_join": op3_ngram_join, "op4_mixing": op4_mixing, "op5_lm_scoring": op5_lm_scoring, "op6_embedding_dedup": op6_embedding_dedup, "op7_quality_classifier": op7_quality_classifier, "op8_secrets": op8_secrets, "op9_suffix_dedup": op9_suffix_dedup, "op10_quality_rules": op10_quality_rules, "op11_line_dedup": op11_line_dedup, "op12_whitening": op12_whitening, "op13_merkle": op13_merkle}
ORACLE_SQL = {"op4_mixing": mixing.mixing_sql(), "op11_line_dedup": line_dedup.line_dedup_sql(), "op13_merkle": merkle.manifest_sql()}
