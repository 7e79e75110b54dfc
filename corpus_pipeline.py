"""A corpus from raw documents to token ids: quality rules, near-duplicates, repeated passages, mixing, tokens.

Null and empty texts fail the rules, and so go in the first stage; a stage on its own gives them what its operator's
docstring says. Rows that repeat are near-duplicates of each other, and one of them stays. Null ids, ties and very long
texts are as in the operators; other columns go along untouched up to the last stage, whatever their names. An empty
table gives an empty result at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import bpe, mixing, near_dup, quality_rules, suffix_dedup
from spanloom.llm.common import Scratch, small_reads, table


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    small_reads(spark)
    return quality_rules.kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with like shingles of five words stays."""
    return near_dup.kept_documents(docs, words=5, percent=80)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, or of 400 bytes, that start more than once go from all texts; the documents stay."""
    return suffix_dedup.cleaned_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies and parts of documents, so that each source has its share of words."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and a digest of what they decode to."""
    out = bpe.encoded(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", remove_repeated_passages),
    ("source_mixing", mix_sources),
    ("bpe_tokens", encode_tokens),
]

#: Repeated passages and token ids can't be stated in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again by the next."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
