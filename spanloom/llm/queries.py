"""The registered queries of the training-data operators: production parameters, whole tables, full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, collocations, html_extract, media_jpeg, mixing, near_dup, ngram_join, quality_gam, quality_rules, suffix_dedup, toxicity
from .common import Scratch, table
from .oracles import ORACLES  # noqa: F401


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", "n_chars")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return out.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.preference_pairs(table(spark, sf_dir, "conversations"))
    spans = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws("-", s["lo"], s["hi"])))
    return out.withColumn("chosen_mask", spans("chosen_mask")).withColumn("rejected_mask", spans("rejected_mask"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judged(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = media_jpeg.stored(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return media_jpeg.described(Scratch(spark, "media").put(files, "files"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.joined(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {
    "op7_preference_format": op7_preference_format,
    "op2_toxicity": op2_toxicity,
    "op5_quality_classifier": op5_quality_classifier,
    "op1_html_extraction": op1_html_extraction,
    "op9_media_jpeg": op9_media_jpeg,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_near_duplicates": op4_near_duplicates,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op10_source_mixing": op10_source_mixing,
    "op11_ngram_join": op11_ngram_join,
    "op12_collocations": op12_collocations,
}
