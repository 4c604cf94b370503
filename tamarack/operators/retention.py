"""Retention: content past its time goes, and what was shown because of it is worked out anew.

Tables lie in folders by buckets of their key. A purge carries the keys that it touches as a delta: only the rows of
these keys are recomputed, and only the buckets that hold them are written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators import lifecycle
from tamarack.operators.resolution import source_rank
from tamarack.scratch import Scratch

#: Columns of stored values beside which others may stand.
VALUE = "business_id long, record_id long, field string, value string, source string, observed_at timestamp, expires_at timestamp, purged_at timestamp"


class Buckets:
    """A table in a folder, by buckets of the hash of a key. Changes are staged as a table of their own, then replace whole buckets.

    A change that is cut short leaves some buckets old and some new, none half written; repeat it.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.hash(self.key), F.lit(self.buckets)))

    def _write(self, rows: DataFrame, mode: str) -> None:
        # a bucket may hold a hot key: it is dealt over several tasks by the rest of the row
        spread = rows.repartition("bucket", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "bucket"]), F.lit(8)))
        spread.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def create(self, rows: DataFrame) -> Buckets:
        self._write(self._with_bucket(rows), "errorifexists")
        return self

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """All rows, or those of ``keys`` (a table with the key): then only the buckets of these are read."""
        rows = self.spark.read.parquet(self.path)
        if keys is None:
            return rows.drop("bucket")
        touched = [r.bucket for r in self._with_bucket(keys.select(self.key)).select("bucket").distinct().collect()]
        return rows.where(F.col("bucket").isin(touched)).join(keys.select(self.key).distinct(), self.key, "left_semi").drop("bucket")

    def replace(self, keys: DataFrame, rows: DataFrame) -> int:
        """Put ``rows`` in the place of all rows of ``keys`` (a table with the key); returns the number of buckets written."""
        marked = self._with_bucket(keys.select(self.key)).distinct()
        touched = [r.bucket for r in marked.select("bucket").distinct().collect()]
        if not touched:
            return 0
        old = self.spark.read.parquet(self.path).where(F.col("bucket").isin(touched))
        kept = old.join(marked.select(self.key), self.key, "left_anti")
        tables = Scratch(self.spark, "buckets")
        staged = tables.keep(kept.unionByName(self._with_bucket(rows.select(*[c for c in old.columns if c != "bucket"]))), "staged")
        self._write(staged, "overwrite")
        tables.drop("staged")
        return len(touched)


def without_keys(text: Column, keys: Sequence[str]) -> Column:
    """JSON text in which the texts, numbers and truth values under these keys are null; the rest stays as written, at any depth.

    A quoted word before a colon is always a key, as quotes inside of texts are escaped.
    """
    for key in keys:
        text = F.regexp_replace(text, rf'("{key}"\s*:\s*)(?:"(?:[^"\\]|\\.)*"|-?\d[\d.eE+\-]*|true|false)', "$1null")
    return text


def is_due(now: Column, expires: str = "expires_at", purged: str = "purged_at") -> Column:
    return F.coalesce((F.col(expires) < now) & F.col(purged).isNull(), F.lit(False))


def purged(rows: DataFrame, now: Column, blank: Sequence[str] = (), json: dict[str, Sequence[str]] | None = None, expires: str = "expires_at") -> DataFrame:
    """Rows whose time is over lose the columns ``blank`` and the keys of JSON columns, and are stamped; a second purge changes nothing."""
    due = is_due(now, expires)
    gone = {c: F.when(~due, F.col(c)) for c in blank}
    gone |= {c: F.when(due, without_keys(F.col(c), keys)).otherwise(F.col(c)) for c, keys in (json or {}).items()}
    return rows.withColumns(gone | {"purged_at": F.when(due, now).otherwise(F.col("purged_at"))})


def shown(values: DataFrame, fields: Sequence[str], priority: tuple[str, ...] = ("google_places", "demo_fixture")) -> DataFrame:
    """(business_id, fields..., content_expires_at): what a business may show of its values that are not purged.

    Of a field the value of the best source, then the newest, then the last record. The fields of the website and of
    the address come each from one record: that of the best kind of website, or with a street, then as before; a record
    that knows none of a group's telling fields cannot give it. A business without values left has no row.
    """
    live = values.where("purged_at is null")
    order = F.struct((-source_rank(F.col("source"), priority)).alias("source"), F.col("observed_at").alias("at"), F.col("record_id").alias("id"))
    groups = {"website": (lifecycle.WEBSITE_GROUP, ("website", "domain")), "address": (lifecycle.ADDRESS_GROUP, lifecycle.ADDRESS_GROUP)}
    grouped = {g: tuple(f for f in of if f in fields) for g, (of, _) in groups.items()}
    single = [f for f in fields if not any(f in of for of in grouped.values())]
    of = lambda f: F.col("field") == f
    known = lambda f: of(f) & F.col("value").isNotNull()
    per_record = [F.max(F.when(of(f), F.col("value"))).alias(f) for f in fields]
    per_record += [F.max(F.when(F.col("field").isin(*names) if names else F.lit(False), order)).alias(f"__{g}") for g, names in grouped.items()]
    per_record += [F.max(F.when(known(f), order)).alias(f"__of_{f}") for f in single]
    records = live.groupBy("business_id", "record_id").agg(*per_record, F.min("expires_at").alias("__until"))
    column = lambda f: F.col(f) if f in fields else F.lit(None).cast("string")
    rank = {"website": lifecycle.website_rank(column("website_kind")), "address": lifecycle.address_rank(column("street_key"), column("address_line1"))}
    best = []
    for g, names in grouped.items():
        telling = [F.col(f) for f in groups[g][1] if f in fields]
        if names:
            wins = F.when(F.coalesce(*telling).isNotNull(), F.struct((-rank[g]).alias("rank"), F.col(f"__{g}").alias("order"))) if telling else F.lit(None)
            best.append(F.max_by(F.struct(*names), wins).alias(f"__best_{g}"))
    best += [F.max_by(f, f"__of_{f}").alias(f) for f in single]
    out = records.groupBy("business_id").agg(*best, F.min("__until").alias("content_expires_at"))
    where = {f: f"__best_{g}.{f}" for g, names in grouped.items() for f in names}
    return out.select("business_id", *[F.col(where.get(f, f)).alias(f) for f in fields], "content_expires_at")


def purge_values(values: Buckets, businesses: Buckets, now: Column, fields: Sequence[str]) -> dict[str, int]:
    """Purge expired values and recompute what their businesses show; returns how many of each, and the buckets written.

    Businesses are written first: if the run ends there, the values are still due and it can be repeated. A business
    whose name is gone shows its id in its place.
    """
    tables = Scratch(values.spark, "purge")
    due = values.read().where(is_due(now))
    touched = tables.keep(due.groupBy("business_id").count(), "touched")
    total = touched.agg(F.count("*").alias("businesses"), F.coalesce(F.sum("count"), F.lit(0)).alias("values")).head()
    if not total.businesses:
        return {"values": 0, "businesses": 0, "buckets": 0}
    after = tables.keep(purged(values.read(touched), now, ["value"]), "after")
    anew = touched.select("business_id").join(shown(after, fields), "business_id", "left")
    if "display_name" in fields:
        anew = anew.withColumn("display_name", F.coalesce("display_name", F.concat(F.lit("[expired] "), F.col("business_id").cast("string"))))
    old = businesses.read(touched)
    rest = [c for c in old.columns if c not in (*fields, "content_expires_at", "business_id")]
    merged = old.select("business_id", *rest).join(anew, "business_id").select(*[c for c in old.columns if c in (*rest, *fields, "content_expires_at", "business_id")])
    written = businesses.replace(touched, tables.keep(merged, "merged"))
    written += values.replace(touched, after)
    return {"values": total["values"], "businesses": total.businesses, "buckets": written}


def purge_rows(table: Buckets, now: Column, blank: Sequence[str] = (), json: dict[str, Sequence[str]] | None = None, expires: str = "content_expires_at") -> int:
    """Purge the content of rows of one table (records, audits, model answers) and return how many lost theirs."""
    tables = Scratch(table.spark, "purge")
    touched = tables.keep(table.read().where(is_due(now, expires)).groupBy(table.key).count(), "touched")
    n = touched.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).head().n
    if n:
        table.replace(touched, tables.keep(purged(table.read(touched), now, blank, json, expires), "after"))
    return n
