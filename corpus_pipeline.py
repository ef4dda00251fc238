"""Corpus pipeline: five stages over documents, each of which works on all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, mixing, nearcopies, quality, rules
from factloom.llm.shared import table, word_count, write_shared


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the limits and not far from their language's and source's center."""
    return rules.keep_regular(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (5-word shingles, Jaccard 0.8 or more): SimHash links first, verified, then an exact join of what they leave apart."""
    return nearcopies.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes."""
    size = word_count(F.col("text")).alias("size")
    planned = mixing.plan(write_shared(docs.select("doc_id", "source", size), "mix-sizes"))
    copies = F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))
    return mixing.with_copies(docs, planned, word_count(F.col("text"))).where("mix_copies > 0").withColumn("mix_copy", copies).select(*docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoded and decoded texts, as digests."""
    return bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"), texts=False)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("BPE encoding", bpe_tokens),
]

#: Hashed models, robust estimates and the automaton have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_shared(docs, f"pipeline-{k}")
    return docs
