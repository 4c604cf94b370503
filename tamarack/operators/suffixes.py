"""Registered domains by a list of public suffixes: rules, wildcards and exceptions, matched label by label from the end.

Each host asks for its suffixes in the table of rules, all of them in one equi join, so the list may have any size; the
longest rule that is there wins, and an exception over all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions import web

# Where the rules of registries end and those of owners of single domains begin in the published list.
PRIVATE = "===BEGIN PRIVATE DOMAINS==="
#: Most labels of a host.
LABELS = 127


def read_rules(spark: SparkSession, path: str, private: bool = True) -> DataFrame:
    """(rule) of a published list: a rule a line up to the first blank, ``//`` begins a comment; in ASCII and small letters.

    Without ``private`` the second part of the list, domains that their owners parcel out, is left out.
    """
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.split(F.col("value") if private else F.substring_index("value", PRIVATE, 1), "\n")).alias("line"))
    return rules_of(whole.select(F.regexp_extract("line", r"^\s*(\S*)", 1).alias("rule")).where("rule <> '' and not startswith(rule, '//')"))


def rules_of(lines: DataFrame) -> DataFrame:
    """Distinct rules (column ``rule``), in ASCII; those that are no names are left out."""
    mark = F.regexp_extract("rule", r"^(!|\*\.)?", 0)
    name = web.ascii_host(F.regexp_replace("rule", r"^(!|\*\.)", ""))
    return lines.select(F.concat(mark, name).alias("rule")).where("rule is not null").distinct()


def _asked(host: Column) -> Column:
    """Rules that would match a host, with the labels of the suffix that each gives it."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    tail = lambda i: F.array_join(F.slice(labels, n - i + 1, i), ".")
    each = F.sequence(F.lit(1), F.least(n, F.lit(LABELS)))
    plain = F.transform(each, lambda i: F.struct(tail(i).alias("rule"), i.alias("labels"), F.lit(0).alias("exception")))
    wild = F.transform(F.filter(each, lambda i: i > 1), lambda i: F.struct(F.concat(F.lit("*."), tail(i - 1)).alias("rule"), i.alias("labels"), F.lit(0).alias("exception")))
    but = F.transform(F.filter(each, lambda i: i > 1), lambda i: F.struct(F.concat(F.lit("!"), tail(i)).alias("rule"), (i - 1).alias("labels"), F.lit(1).alias("exception")))
    return F.concat(plain, wild, but)


def with_registered_domain(rows: DataFrame, host: str, rules: DataFrame, default: bool = False) -> DataFrame:
    """Adds ``public_suffix`` and ``registered_domain`` (the suffix and one label more) of the column ``host``.

    Hosts are read in small letters and ASCII, without a final dot. Without a rule both are null, or, with ``default``, the last
    label is the suffix. A host that is a suffix itself has no registered domain; nor have blank hosts, addresses of
    numbers, and hosts with empty labels. Each distinct host is looked up once.
    """
    named = rows.withColumn("__host", web.ascii_host(F.col(host)))
    hosts = named.select("__host").where(F.col("__host").isNotNull() & ~F.col("__host").rlike(r"^\.|\.\.|^[0-9.]+$")).distinct()
    asked = hosts.select("__host", F.inline(_asked(F.col("__host"))))
    best = asked.join(rules, "rule").groupBy("__host").agg(F.max(F.struct("exception", "labels")).alias("best"))
    labels = F.split("__host", r"\.")
    tail = lambda n: F.when(F.size(labels) >= n, F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    if default:
        best = hosts.join(best, "__host", "left")
    n = F.coalesce(F.col("best.labels"), F.lit(1))
    found = best.select("__host", tail(n).alias("public_suffix"), tail(n + 1).alias("registered_domain"))
    return named.join(found, "__host", "left").drop("__host")
