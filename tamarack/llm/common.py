"""What several operators share: word counts, document keys, and Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.session import ship

WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; also sees to it that executors have this package."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text, in SQL; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """128 bits that tell apart rows that share a doc_id (or have none); all 0 for null."""
    return F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(bytes(16)))


def matched(docs: DataFrame, picked: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, ``key``) is in ``picked`` (doc_id, key, ...), each such pair once.

    Further columns of ``picked`` come along. Join and removal of repeats share one partitioning.
    """
    own = ["__tm_id", "__tm_none", "__tm_key"]
    ids = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(own[0]), F.col("doc_id").isNull().alias(own[1])]
    rows = docs.select("*", *ids, key.alias(own[2]))
    return rows.join(picked.select(*ids, F.col("key").alias(own[2]), *[c for c in picked.columns if c not in ("doc_id", "key")]), own).dropDuplicates(own).drop(*own)


def encoded(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``limit`` bytes of text each, and the texts; only a slice's texts are copied."""
    from tamarack.llm.hashing import slices

    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        for lo, hi in slices(sizes, limit):
            part = batch.slice(lo, hi - lo)
            yield part, encoded(part.column(column))
