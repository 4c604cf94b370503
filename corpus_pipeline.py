"""From raw documents to shards of a training mix: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamarack.llm import common, decontaminate, jaccard, language, mixing, sharding
from tamarack.scratch import Scratch
from tamarack.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those that identification rejects go.

    Texts that are null, empty or without a letter go; repeated rows go or stay together; texts are read whole.
    """
    ship(spark)
    return language.accepted(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least doc_id, ties broken by the text's hash.

    Rows without words are in no group and stay; of repeated rows one stays.
    """
    ship(spark)
    return jaccard.distinct(spark, docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold a benchmark item.

    Null and empty texts stay; repeated rows go or stay together; an empty benchmark leaves all.
    """
    return decontaminate.clean(spark, docs, common.load(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, shard by shard in the shards' order: repeats are rows of their own.

    Null sources are one source, null and empty texts have size 0; equal rows give equal draws on reruns.
    """
    return mixing.mixed(spark, docs)


def byte_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row; repeats have slots of their own, null and empty texts weigh 1. Few rows leave shards empty."""
    return sharding.shard(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("byte_sharding", byte_sharding),
]

#: Models, MinHash and tiling have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written as a table that the next reads. An empty table gives an empty result."""
    tables = Scratch(spark, "pipeline")
    docs = common.load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tables.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
