"""Balanced contiguous shards from global byte-size prefix sums, in DataFrame operations only.

Rows get a global order (by text hash, so that equal texts lie side by side, then by doc_id), dealt to
range partitions. Each partition's total gives, summed over the partitions before it, the offset of its
rows; running sums inside a partition do the rest, so no task sees more than a partition. Cuts at equal
byte targets make the shards. A group of equal texts that a cut would part goes whole to the side of its
middle if it is small against a shard; at most one group lies at each cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.llm import common
from tamarack.scratch import Scratch

SHARDS = 16
#: A group of equal texts stays whole up to this share of a shard's target.
WHOLE = 0.01


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, whole: float = WHOLE) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null).

    Size is the UTF-8 bytes of the text plus 1, so null and empty texts weigh 1. Shard sizes differ from
    the target by no more than ``whole`` of it and the texts at the cuts. Slots count from 0 in each
    shard. Repeated rows are rows of their own with slots of their own. Other columns are not read;
    an empty table gives an empty result, and few rows may leave shards empty.
    """
    tables = Scratch(spark, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = tables.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (common.n_bytes(F.col("text")) + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hash")), "sizes")
    order = ["hash", "doc_id", "text_crc32", "size"]
    dealt = tables.keep(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "dealt")
    tables.drop("sizes")
    # one row for each partition, so the window without keys stays as small as the number of partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_offset"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_offset"))
    total = totals.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).head().n
    inside = Window.partitionBy("part").orderBy(*order)
    placed = dealt.join(offsets, "part").select(
        "doc_id", "size", "text_crc32", "hash", (F.col("byte_offset") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"), (F.col("row_offset") + F.row_number().over(inside) - 1).alias("place")
    )
    last = F.lit(shards - 1)
    at = lambda start, size: F.least(F.floor((start + size / 2) * F.lit(shards) / F.lit(max(1, total))), last).cast("int")
    placed = tables.keep(placed.withColumn("shard", at(F.col("start"), F.col("size"))), "placed")
    tables.drop("dealt")
    parted = placed.groupBy("hash").agg(F.min("shard").alias("low"), F.max("shard").alias("high"), F.sum("size").alias("bytes"), F.min("start").alias("start")).where(F.col("low") < F.col("high"))
    moved = parted.where(F.col("bytes") <= F.lit(whole * total / shards)).select("hash", at(F.col("start"), F.col("bytes")).alias("moved"))
    # a group that lies at a cut: no more than the number of cuts
    settled = placed.join(F.broadcast(moved), "hash", "left").withColumn("shard", F.coalesce("moved", "shard"))
    first = settled.groupBy("shard").agg(F.min("place").alias("first"))
    return settled.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each row of ``documents``; see ``shard``."""
    return shard(spark, common.load(spark, sf_dir, "documents"))
