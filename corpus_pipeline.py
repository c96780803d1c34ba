"""A training-corpus pipeline over documents: five stages, each written as Parquet and reread.

Quality classification, near-dedup, substring dedup, mixing and packing.  Every stage works on all rows
that its predecessor kept.  All but the last return the columns of documents; the last returns
pieces of packed sequences.  Rows stay whole but for the bytes that the third stage cuts out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm import mixing, packing, quality, simhash, suffix_dedup
from ridgeline.sources.scratch import Scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the ordinal model, fitted on labelled rows of docs, holds for toxic or poor."""
    return quality.select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group linked by SimHash fingerprints."""
    return simhash.dedup(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out bytes of 100-byte strings that also start earlier."""
    return suffix_dedup.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents by source, towards the target weights."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens."""
    return packing.pack(docs, with_ids=False)


STAGES = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", near_dedup),
    ("suffix-array dedup", substring_dedup),
    ("mixing to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier and the sort orders of packing are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on the documents of a folder of tables."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        after = scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = after
    return docs
