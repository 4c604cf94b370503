"""Relational building blocks: newest row, streaks, keyset pages, disjunctive anti joins, merges, zero fill."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by ``order``. Partial aggregation keeps one row a key before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def newest_n(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key, with ``rank`` from 1. Spark cuts each group at n before the shuffle."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def streak(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Per key, the newest ``value`` and how many rows in a row have it, newest first."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    run = df.withColumn("__first", F.first(value).over(w)).withColumn("__breaks", F.sum(F.when(F.col(value).eqNullSafe(F.col("__first")), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where("__breaks = 0").groupBy(key).agg(F.first("__first").alias(value), F.count("*").alias("streak"))


def any_key_anti(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of ``left`` that match no row of ``right`` on any of the key pairs; null matches nothing.

    One equi anti join for each pair, as a disjunction would be a nested loop.
    """
    for a, b in keys:
        left = left.join(right.select(F.col(b).alias(a)).where(F.col(a).isNotNull()).distinct(), a, "left_anti").select(*left.columns)
    return left


def any_key_semi(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], ident: str) -> DataFrame:
    """Rows of ``left`` that match a row of ``right`` on some key pair, each once; ``ident`` is unique in ``left``."""
    found = reduce(DataFrame.union, [left.join(right.select(F.col(b).alias(a)).where(F.col(a).isNotNull()).distinct(), a, "left_semi").select(ident) for a, b in keys]).distinct()
    return left.join(found, ident, "left_semi").select(*left.columns)


def keyset_page(df: DataFrame, keys: list[str], limit: int, after: tuple | None = None) -> DataFrame:
    """``limit`` + 1 rows after ``after`` in descending order of ``keys`` (the last is unique); the extra row says that there are more."""
    if after is not None:
        df = df.where(F.struct(*keys) < F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True)]))
    return df.orderBy(*[F.col(k).desc() for k in keys]).limit(limit + 1)


def keyset_page_at(df: DataFrame, keys: list[str], limit: int, cursor: DataFrame) -> DataFrame:
    """The page after the one row of ``cursor`` (the same keys), which is joined and not fetched; an empty cursor gives an empty page."""
    at = cursor.select(F.struct(*keys).alias("__at")).limit(1)
    past = df.join(F.broadcast(at), F.struct(*keys) < F.col("__at"))  # one row
    return past.select(*df.columns).orderBy(*[F.col(k).desc() for k in keys]).limit(limit + 1)


def keyset_page_nulls_last(df: DataFrame, key: str, ident: str, limit: int, after: tuple | None = None, descending: bool = True) -> DataFrame:
    """A page by (key, ident) with null keys at the end, whichever the direction."""
    if after is not None:
        value, last = after
        past = (lambda c, v: c < v) if descending else (lambda c, v: c > v)
        tie = past(F.col(ident), F.lit(last))
        if value is None:
            df = df.where(F.col(key).isNull() & tie)
        else:
            df = df.where(past(F.col(key), F.lit(value)) | ((F.col(key) == F.lit(value)) & tie) | F.col(key).isNull())
    by = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    return df.orderBy(by, F.col(ident).desc() if descending else F.col(ident).asc()).limit(limit + 1)


def not_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left.key NOT IN right.key`` with SQL's rule for nulls: a null on the right, or on the left if there is any right row, is unknown.

    One equi anti join and a count of one row, not the nested loop that Spark plans for NOT IN of several keys.
    """
    told = right.agg(F.count("*").alias("__rows"), F.count_if(F.col(key).isNull()).alias("__nulls"))
    out = left.join(right.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti").select(*left.columns)
    out = out.join(F.broadcast(told))  # one row
    return out.where((F.col("__rows") == 0) | (F.col("__nulls") == 0) & F.col(key).isNotNull()).select(*left.columns)


def zero_filled(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Rows of each of ``values``, also where there are none."""
    names = df.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return names.join(df.groupBy(key).count(), key, "left").select(key, F.coalesce("count", F.lit(0)).alias("n"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Full outer merge: what ``new`` gives (non-null) wins, the rest stays.

    Of several new rows of a key each column takes its value from the last row, by ``order``, that has one
    (without ``order``, by all columns of the row, so that reruns agree).
    """
    rest = [c for c in old.columns if c not in keys]
    given = [c for c in rest if c in new.columns]
    by = F.struct(*(order or [c for c in new.columns if c not in keys]))
    last = new.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), by)).alias(c) for c in given])
    joined = old.alias("o").join(last.alias("n"), keys, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in given else F.col(f"o.{c}")
    return joined.select(*keys, *[pick(c).alias(c) for c in rest])


def seen_again(old: DataFrame, new: DataFrame, keys: list[str], seen: str) -> DataFrame:
    """Repeated sightings of a record: the first time stays, all else is as of the last (of equal times the greatest row); idempotent."""
    rows = old.unionByName(new.withColumn("first_seen", F.col(seen)), allowMissingColumns=True)
    rest = [c for c in old.columns if c not in (*keys, "first_seen")]
    return rows.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max_by(F.struct(*rest), F.struct(seen, *rest)).alias("__r")).select(*keys, "first_seen", "__r.*").select(*old.columns)


def sync_links(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """What to do to make ``current`` equal ``wanted``: their columns and ``action`` (delete or insert)."""
    return current.exceptAll(wanted).withColumn("action", F.lit("delete")).unionByName(wanted.exceptAll(current).withColumn("action", F.lit("insert")))


def unpivot(df: DataFrame, ident: str, fields: Sequence[str]) -> DataFrame:
    """One (ident, field, value as text) row for each non-null field."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(ident, F.inline(pairs)).where(F.col("value").isNotNull())


def pivot(df: DataFrame, ident: str, fields: Sequence[str]) -> DataFrame:
    """Back to a column for each field (as text)."""
    return df.groupBy(ident).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])


def expired(df: DataFrame, when: Column, blank: Sequence[str], stamp: str | None = None, now: Column | None = None) -> DataFrame:
    """Content of rows past their time is nulled; rows stay. Idempotent."""
    out = df.withColumn("__gone", F.coalesce(when, F.lit(False)))
    for c in blank:
        out = out.withColumn(c, F.when(~F.col("__gone"), F.col(c)))
    if stamp:
        out = out.withColumn(stamp, F.when(F.col("__gone"), F.coalesce(F.col(stamp), now)).otherwise(F.col(stamp)))
    return out.drop("__gone")


def sessions(df: DataFrame, key: str, time: str, order: list[str], gap_seconds: int) -> DataFrame:
    """Adds ``session`` (from 1 per key): a new one begins after a gap of more than ``gap_seconds``."""
    w = Window.partitionBy(key).orderBy(*order)
    seconds = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = seconds(F.col(time)) - F.lag(seconds(F.col(time))).over(w)
    return df.withColumn("__new", F.when(gap <= gap_seconds * 1_000_000, 0).otherwise(1)).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def capped(df: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """Adds ``n`` (running count per key) and ``over`` (whether it exceeds the cap)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("n", F.row_number().over(w)).withColumn("over", F.col("n") > cap)


def ancestors(nodes: DataFrame, parents: DataFrame, ident: str, parent: str, levels: int) -> DataFrame:
    """(ident, level, ancestor): parents of each node up to ``levels`` steps, newest first."""
    walk = nodes.select(F.col(ident).alias("start"), F.col(parent).alias("at"))
    out = []
    for level in range(1, levels + 1):
        out.append(walk.where("at is not null").select("start", F.lit(level).alias("level"), F.col("at").alias("ancestor")))
        walk = walk.join(parents.select(F.col(ident).alias("at"), F.col(parent).alias("__up")), "at").select("start", F.col("__up").alias("at"))
    return reduce(DataFrame.union, out)
