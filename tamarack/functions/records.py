"""Hashes, cursors, JSON documents and DNS records, in built-in expressions."""

from __future__ import annotations

import base64

from pyspark.sql import Column
from pyspark.sql import functions as F


def payload_hash(**fields: Column) -> Column:
    """sha256 of canonical JSON: keys sorted, no blanks, nulls written."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def input_hash(version: str, model: Column, body: Column) -> Column:
    """sha256 of the parts as a JSON array, so that no two inputs run together and null is a value of its own."""
    return F.sha2(F.to_json(F.array(F.lit(version), model.cast("string"), body.cast("string"))), 256)


def encode_cursor(*parts: Column) -> Column:
    """base64url of the parts joined by ``|``, without padding."""
    return F.regexp_replace(F.translate(F.base64(F.concat_ws("|", *parts).cast("binary")), "+/", "-_"), "[=\\s]", "")


def decode_cursor(cursor: str) -> list[str]:
    return base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)).decode().split("|")


def first_txt(values: Column, prefix: str) -> Column:
    """First TXT value that begins with a version tag such as ``v=spf1``."""
    return F.get(F.filter(values, lambda v: v.rlike(rf"(?i)^{prefix}(\s|;|$)")), F.lit(0))


def dmarc_tag(record: Column, tag: str) -> Column:
    """Value of the first such tag of a DMARC record."""
    tags = F.transform(F.split(record, ";"), lambda p: F.split(F.trim(p), r"\s*=\s*", 2))
    return F.lower(F.trim(F.get(F.get(F.filter(tags, lambda t: F.lower(F.get(t, F.lit(0))) == tag), F.lit(0)), F.lit(1))))


def spf_allows_all(record: Column) -> Column:
    return F.lower(record).rlike(r"(^|\s)\+?all(\s|$)")


def rdap(doc: Column) -> Column:
    """{expires, registered, statuses} of an RDAP domain document; null without an expiry."""
    parsed = F.from_json(doc, "objectClassName string, ldhName string, status array<string>, events array<struct<eventAction: string, eventDate: timestamp>>")
    first = lambda kind: F.get(F.filter(parsed["events"], lambda e: e["eventAction"] == kind), F.lit(0))["eventDate"]
    return F.when(first("expiration").isNotNull(), F.struct(first("expiration").alias("expires"), first("registration").alias("registered"), parsed["status"].alias("statuses")))


def page_speed(doc: Column) -> Column:
    """{performance, accessibility, best_practices, lcp_ms, cls, tbt_ms, crux} of a PageSpeed document."""
    at = lambda path: F.get_json_object(doc, f"$.lighthouseResult.{path}")
    score = lambda key: F.round(at(f"categories.{key}.score").cast("double") * 100).cast("int")
    audit = lambda key: at(f"audits['{key}'].numericValue").cast("double")
    return F.struct(
        score("performance").alias("performance"), score("accessibility").alias("accessibility"), at("categories['best-practices'].score").cast("double").alias("best_raw"), audit("largest-contentful-paint").cast("int").alias("lcp_ms"), F.round(audit("cumulative-layout-shift"), 3).alias("cls"),
        audit("total-blocking-time").cast("int").alias("tbt_ms"), F.get_json_object(doc, "$.loadingExperience.overall_category").alias("crux"),
    )


def robots_allowed(status: Column, allowed_by_rules: Column) -> Column:
    """4xx allows all, other answers than 2xx allow nothing, else the rules decide."""
    return F.when(status.between(400, 499), True).when(~status.between(200, 299) | status.isNull(), False).otherwise(allowed_by_rules)


def fresh(checked_at: Column, now: Column, seconds: int) -> Column:
    """Whether a snapshot is younger than ``seconds``; one that was never taken is not."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(checked_at) < seconds, F.lit(False))


# What a log must not show, and what stands for it.
_SECRETS = (
    (r"(?i)\b(password|passwd|secret|token|api[_-]?key|authorization)(\"?\s*[:=]\s*\"?)(?:bearer\s+)?[^\s\",;]+", "$1$2***"),
    (r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+", "Bearer ***"),
    (r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "***"),
    (r"(?i)\b([a-z][a-z0-9+.-]*://[^\s:/@]+):[^\s@]+@", "$1:***@"),
)


def scrub_log(text: Column) -> Column:
    """Named keys, bearer and web tokens, and passwords in URLs, replaced."""
    for pattern, mark in _SECRETS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def protect_cell(value: Column) -> Column:
    """Text of a spreadsheet cell: null is empty, a leading sign that starts a formula gets a quote before it."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
