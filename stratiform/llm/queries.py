"""Registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratiform.llm import attention_lm, debruijn, decontaminate, filter_lattice, genetic_packing, license_ac, line_rules, quality_fm, secret_cnn, segment_negatives, simhash_vp, url_gbt, warc_bundles
from stratiform.llm.frames import held_out, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = quality_fm.train(docs, labels, usable=~held_out("doc_id", 5), metadata=["n_chars"])
    return quality_fm.scores(docs, machine, metadata=["n_chars"]).select(
        "doc_id", held_out("doc_id", 5).alias("held_out"), "score", (F.col("score") >= quality_fm.THRESHOLD).cast("int").alias("predicted")
    )


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = debruijn.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records = warc_bundles.read_bundles(*warc_bundles.write_bundles(pages))
    kind = pages.schema["page_id"].dataType
    return records.select(F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_vp.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_vp.hex16("fp").alias("fingerprint"), "component_id")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_ac.licenses(table(spark, sf_dir, "documents"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = attention_lm.scores(table(spark, sf_dir, "documents"), ~held_out("doc_id", 10), vocabulary)
    return found.withColumn("held_out", held_out("doc_id", 10))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_gbt.judge(table(spark, sf_dir, "pages"))


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.with_rules(table(spark, sf_dir, "documents")).drop("cleaned")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genetic_packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_cnn.findings(docs, secret_cnn.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_model")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_lattice.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return segment_negatives.mine(rows, F.col("id") % 50 == 0)


QUERIES = {
    "op1_quality": op1_quality,
    "op2_substrings": op2_substrings,
    "op3_warc": op3_warc,
    "op4_simhash": op4_simhash,
    "op5_licenses": op5_licenses,
    "op6_lm": op6_lm,
    "op7_urls": op7_urls,
    "op8_line_rules": op8_line_rules,
    "op9_packing": op9_packing,
    "op10_decontaminate": op10_decontaminate,
    "op11_secrets": op11_secrets,
    "op12_filter_audit": op12_filter_audit,
    "op13_hard_negatives": op13_hard_negatives,
}
