"""Where leads are delivered: a registry of destinations, and one that is a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators.lifecycle import LEAD_FIELDS

#: What a destination holds before anything is written to it.
EMPTY = ", ".join(f"{c} {'int' if c == 'lead_score' else 'boolean' if c == 'do_not_contact' else 'string'}" for c in LEAD_FIELDS) + ", withdrawn boolean"

_DESTINATIONS: dict[str, Callable[..., object]] = {}


def register(name: str):
    """Name a destination: a factory of (spark, path) that returns an object with the methods of ``TableDestination``."""

    def add(factory: Callable[..., object]) -> Callable[..., object]:
        if name in _DESTINATIONS:
            raise ValueError(f"destination {name} is registered")
        _DESTINATIONS[name] = factory
        return factory

    return add


def get(name: str, *args: object) -> object:
    return _DESTINATIONS[name](*args)


def names() -> list[str]:
    return sorted(_DESTINATIONS)


@register("table")
class TableDestination:
    """Leads keyed by ``business_key`` in a folder of versions; each change is a new version, the newest is read.

    For a stream, call ``upsert`` from ``foreachBatch``: a batch that is delivered again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, create_only: tuple[str, ...] = ("assigned_rep", "status", "follow_up_date", "notes")):
        self.spark, self.path, self.create_only = spark, path.rstrip("/"), create_only

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        done = lambda p: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName()[1:]) for s in files.listStatus(path) if s.getPath().getName()[1:].isdigit() and done(s.getPath()))

    def read(self) -> DataFrame:
        """The newest version; an empty table of lead records before the first."""
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/v{versions[-1]}") if versions else self.spark.createDataFrame([], EMPTY)

    def _write(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/v{(self._versions() or [0])[-1] + 1}")

    def upsert(self, leads: DataFrame) -> None:
        """New leads come in; of known ones all columns are replaced but those that are set on creation only, and what marks them."""
        rest = [c for c in leads.columns if c != "business_key"]
        # of several rows of a key the greatest counts, so that a batch that is delivered again gives the same
        fresh = leads.groupBy("business_key").agg(F.max(F.struct(*rest)).alias("r")).select("business_key", "r.*").select(*leads.columns)
        if not self._versions():
            return self._write(fresh.withColumn("withdrawn", F.lit(False)))
        old = self.read()
        joined = old.alias("o").join(fresh.alias("n"), "business_key", "full_outer")
        given = F.col("n.business_name").isNotNull() if "business_name" in leads.columns else F.lit(True)
        kept = [c for c in old.columns if c != "business_key"]

        def pick(c: str) -> Column:
            if c == "withdrawn":
                return F.when(given, False).otherwise(F.col("o.withdrawn"))
            if c in self.create_only or c == "do_not_contact":
                return F.coalesce(f"o.{c}", f"n.{c}")
            return F.when(given, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

        self._write(joined.select("business_key", *[pick(c).alias(c) for c in kept]))

    def find_by_keys(self, keys: DataFrame) -> DataFrame:
        return self.read().join(keys.select("business_key").distinct(), "business_key", "left_semi")

    def _flag(self, keys: DataFrame, column: str) -> None:
        if not self._versions():
            return
        rows = self.read()
        marked = keys.select("business_key", F.lit(True).alias("__hit")).distinct()
        self._write(rows.join(marked, "business_key", "left").withColumn(column, F.coalesce(F.col("__hit"), F.col(column))).select(*rows.columns))

    def mark_do_not_contact(self, keys: DataFrame) -> None:
        self._flag(keys, "do_not_contact")

    def withdraw(self, keys: DataFrame) -> None:
        self._flag(keys, "withdrawn")

    def check(self) -> bool:
        return bool(self._versions())
