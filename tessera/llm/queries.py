"""The registered queries of this subpackage: each thin wrapper derives its contract's columns
from an operator's own output, over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ctph, feistel, hyperminhash, line_templates, mixing, ri_classifier, rule_ledger, token_counts, url_filter, wfst
from tessera.llm.common import table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages)
    return judged.select("page_id", "host", "path", "rule", "verdict", "pattern")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring(docs)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "epochs", "sampled")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = feistel.assign_shards(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "number")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = rule_ledger.ledger(docs)
    base = F.col("failed").bitwiseAND(F.lit(rule_ledger.POLICIES["base.v1"])) != 0
    return judged.select(
        "doc_id",
        *[F.col(f"measured.{m}").alias(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base.alias("base_failed"),
        rule_ledger.apply_policy(judged, "web.v2").alias("kept"),
        "failed",
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ri_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_url_filter, op3_line_dedup, op4_mixing, op5_sharding, op6_fingerprints, op7_quality_rules, op8_quality_classifier, op9_token_counts, op10_minhash_near_dedup)}
