"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm import (
    bwt_dedup,
    class_lm,
    html_text,
    language_id,
    mixing,
    pii,
    prefix_trie,
    quality,
    secrets,
    simhash,
    spelling,
    suffix_arrays,
    token_counts,
)
from reviewloom.llm.rows import bytes_of, read_table


def op1_private_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal_data(read_table(spark, sf, "documents").select("doc_id", "text")).drop("text")


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    return quality.judge(docs).select("doc_id", *quality.COUNTS[:5], "base_failed", "kept")


def op3_main_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    model = language_id.train(docs.filter(~language_id.held_out()))
    marked = docs.select("doc_id", language_id.held_out().alias("held_out"), "text")
    return language_id.identify(marked, model).drop("text")


def op5_brown_lm(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    model, counts = class_lm.train(docs.filter(~class_lm.held_out()).select(bytes_of("text").alias("text")))
    marked = docs.select("doc_id", class_lm.held_out().alias("held_out"), "text")
    scored = class_lm.score_texts(marked, model, counts)
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("bigint"))


def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op7_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf, "documents").select("doc_id", "text"))


def op8_entropy_mix(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_simhash_neardup(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf, "documents").select("doc_id", "text"))
    shown = F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint")
    return found.select("doc_id", shown, "component_id")


def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return suffix_arrays.contamination(docs, read_table(spark, sf, "benchmark")).drop("text")


def op11_repeated_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return bwt_dedup.repeated_bytes(read_table(spark, sf, "documents").select("doc_id", "text"))


def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    found = spelling.spelling_variants(read_table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf, "conversations"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = [
        op1_private_data, op2_quality_rules, op3_main_text, op4_language_id, op5_brown_lm,
        op6_token_counts, op7_secret_scan, op8_entropy_mix, op9_simhash_neardup, op10_decontamination,
        op11_repeated_bytes, op12_spelling_variants, op13_prefix_trie,
    ]
    return {f.__name__: f for f in listed}


def registered_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality.SQL,
        "op11_repeated_bytes": bwt_dedup.SQL,
        "op12_spelling_variants": spelling.sql(prefix_trie.CRC32),
        "op13_prefix_trie": prefix_trie.SQL,
    }
