"""Personal data: found and replaced by tokens, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and tokens.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\(?\d(?=(?:[\s().\-]*\d){6})[\d\s().\-]{5,}\d"
URL = r"(?i)(?:https?://|www\.)[^\s<>\"'()]+"
STREETS = "street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|way|court|ct|highway|hwy|parkway|pkwy|place|pl|trail|trl|circle|cir|terrace|ter|square|sq|loop|expressway|expy|freeway|fwy|route|rte"
ADDRESS = rf"(?i)\b\d{{1,6}}[A-Za-z]?\s+(?:[A-Za-z0-9'.\-]+\s+){{0,4}}(?:{STREETS})\b\.?"
# What is replaced by which token, in this order.
TOKENS = ((PHONE, "[phone removed]"), (EMAIL, "[email removed]"), (ADDRESS, "[address removed]"))


def replaced(text: Column, *patterns: str) -> Column:
    """``text`` with what these of the patterns find replaced by their tokens."""
    for pattern, token in TOKENS:
        if pattern in patterns:
            text = F.regexp_replace(text, pattern, token)
    return text


def without_known(text: Column, known: Column) -> Column:
    """``text`` with each of the literal addresses (an array) replaced, the longest first, in any case."""
    token = TOKENS[2][1]
    literals = F.array_sort(F.filter(known, lambda k: F.length(F.trim(k)) > 0), lambda a, b: F.length(b) - F.length(a))
    pattern = lambda k: F.concat(F.lit("(?i)"), F.regexp_replace(F.trim(k), r"([\\.\[\]{}()*+?^$|\-])", r"\\$1"))
    return F.aggregate(F.coalesce(literals, F.array().cast("array<string>")), text, lambda acc, k: F.regexp_replace(acc, pattern(k), F.lit(token)))


def scrub(text: Column, known: Column | None = None) -> Column:
    """Known literal addresses, then phones, e-mail addresses and street addresses."""
    return replaced(text if known is None else without_known(text, known), *(p for p, _ in TOKENS))


def find(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
