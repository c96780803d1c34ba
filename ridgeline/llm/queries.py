"""The queries of this subpackage, by name, and their SQL where DuckDB can run it on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm import licenses, mixing, oracles


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import suffix_dedup

    return suffix_dedup.report(documents(spark, sf_dir)).drop("removed")


def op2_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import quality

    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import fingerprints

    return fingerprints.compare(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import packing

    return packing.pack(documents(spark, sf_dir), with_ids=False)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import simhash

    return simhash.cluster(documents(spark, sf_dir))


def op8_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import debruijn

    return debruijn.report(documents(spark, sf_dir)).drop("spans")


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import flac

    return flac.digest(flac.media(documents(spark, sf_dir)))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ridgeline.llm import langid

    return langid.evaluate(documents(spark, sf_dir)).drop("spans")


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_pareto_mix, op3_quality, op4_licenses, op5_fingerprints, op6_packing, op7_simhash, op8_debruijn, op9_flac, op10_langid)}

ORACLES: dict[str, str] = {"op1_suffix_dedup": oracles.SUFFIX, "op2_pareto_mix": mixing.SQL, "op4_licenses": licenses.sql(), "op8_debruijn": oracles.DEBRUIJN}
