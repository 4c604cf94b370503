"""Snapshots that can be told from changed ones, and a log that only grows and shows where it was touched.

A table's digest does not depend on the order of its rows: it is the number of rows and the sum of two halves of a
SHA-256 of each, so it is summed where the rows lie. A log's batches are chained: each digest holds the one before.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, rows long, high string, low string, schema string"
CHAIN = "batch long, rows long, high string, low string, schema string, before string, digest string"


def _row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row as JSON with its nulls, columns by name."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)


def digest(df: DataFrame) -> DataFrame:
    """One row (rows, high, low, schema): the multiset of rows, whatever their order and partitions. An empty table sums to 0."""
    half = lambda at: F.conv(F.substring("d", at, 15), 16, 10).cast("decimal(38,0)")
    kinds = df.schema
    summed = df.select(_row_digest(df).alias("d")).agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(half(at)), F.lit(0).cast("decimal(38,0)")).cast("string").alias(name) for at, name in ((1, "high"), (17, "low"))])
    named = json.dumps(sorted((f.name, f.dataType.simpleString()) for f in kinds))
    return summed.withColumn("schema", F.lit(named))


def snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write each table below ``path`` and, last of all, a manifest of their digests, which is returned.

    The digests are of what was written, read back. A folder without a manifest is no snapshot. A path is used once.
    """
    found = None
    for name, df in sorted(tables.items()):
        spark = df.sparkSession
        df.write.parquet(f"{path}/tables/{name}")
        one = digest(spark.read.schema(df.schema).parquet(f"{path}/tables/{name}")).select(F.lit(name).alias("name"), "rows", "high", "low", "schema")
        found = one if found is None else found.union(one)
    found.coalesce(1).write.json(f"{path}/manifest")
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(name, ok, error) of each table of a snapshot: read as a restored copy and held against the manifest.

    Never raises for a bad copy: what is wrong with it is the answer. Without a manifest there is one row without a name.
    """
    from pyspark.errors import PySparkException

    try:
        rows = spark.read.schema(MANIFEST).json(f"{path}/manifest").collect()  # a row for each table
    except PySparkException as exc:
        return spark.createDataFrame([(None, False, f"no manifest: {type(exc).__name__}")], "name string, ok boolean, error string")
    out = []
    for r in rows:
        try:
            now = digest(spark.read.parquet(f"{path}/tables/{r.name}")).head()
            wrong = next((f"{c}: {now[c]} instead of {r[c]}" for c in ("schema", "rows", "high", "low") if now[c] != r[c]), None)
        except PySparkException as exc:
            wrong = f"cannot be read: {type(exc).__name__}"
        out.append((r.name, wrong is None, wrong))
    return spark.createDataFrame(out, "name string, ok boolean, error string")


def _link(before: str, batch: int, r) -> str:
    return hashlib.sha256(json.dumps([before, batch, r["rows"], r["high"], r["low"], r["schema"]]).encode()).hexdigest()


class ChainedLog:
    """A log of batches in a folder. Nothing here changes or removes what it holds; ``check`` tells what something else did to it.

    For one writer at a time: a batch that another one has written meanwhile makes the append fail. A batch without its link in the
    chain, left by a writer that was stopped, is not part of the log, and is reported; remove it to go on.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self, kind: str) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(name.partition("=")[2]) for name in found if name.startswith("batch="))

    def _links(self) -> list:
        numbers = self._folders("chain")
        if not numbers:
            return []
        links = self.spark.read.schema(CHAIN.replace("batch long, ", "")).json([f"{self.path}/chain/batch={i}" for i in numbers]).withColumn("batch", F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("long"))
        return links.orderBy("batch").collect()  # a row for each batch

    def append(self, rows: DataFrame, at: Column | None = None) -> int:
        """Add a batch, stamped with ``at`` if given, and its link; returns its number."""
        links = self._links()
        number = links[-1].batch + 1 if links else 0
        place = f"{self.path}/rows/batch={number}"
        stamped = rows if at is None else rows.withColumn("at", at)
        stamped.write.parquet(place)
        r = digest(self.spark.read.schema(stamped.schema).parquet(place)).head()
        before = links[-1].digest if links else ""
        link = [(r.rows, r.high, r.low, r.schema, before, _link(before, number, r))]
        self.spark.createDataFrame(link, CHAIN.replace("batch long, ", "")).coalesce(1).write.json(f"{self.path}/chain/batch={number}")
        return number

    def read(self) -> DataFrame:
        """The rows of all linked batches, with ``batch``."""
        numbers = [r.batch for r in self._links()]
        if not numbers:
            raise ValueError(f"{self.path} holds no batch")
        return self.spark.read.option("basePath", f"{self.path}/rows").option("mergeSchema", "true").parquet(*[f"{self.path}/rows/batch={i}" for i in numbers])

    def check(self) -> list[str]:
        """What is wrong with the log: batches changed, dropped, reordered or not linked, links changed or dropped; empty if nothing is."""
        from pyspark.errors import PySparkException

        wrong, before = [], ""
        links = self._links()
        held = set(self._folders("rows"))
        wrong += [f"batch {i} has no link" for i in sorted(held - {r.batch for r in links})]
        for place, r in enumerate(links):
            if r.batch != place or r.before != before or r.digest != _link(r.before, r.batch, r):
                wrong.append(f"link {r.batch} does not follow the one before")
            before = r.digest
            if r.batch not in held:
                wrong.append(f"batch {r.batch} is gone")
                continue
            try:
                now = digest(self.spark.read.parquet(f"{self.path}/rows/batch={r.batch}")).head()
                if any(now[c] != r[c] for c in ("rows", "high", "low", "schema")):
                    wrong.append(f"batch {r.batch} was changed")
            except PySparkException:
                wrong.append(f"batch {r.batch} cannot be read")
        return wrong
