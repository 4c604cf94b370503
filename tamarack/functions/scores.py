"""Signals, rates and scores, in built-in expressions. Unknown never matches unknown."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, floors and caps of resolution and scoring.
PAIR_WEIGHTS = {"domain": 0.30, "phone": 0.30, "name": 0.20, "address": 0.15, "geo": 0.05}
AUTO_MERGE, REVIEW, REVIEW_NAME, STRONG_NAME = 0.85, 0.60, 0.8, 0.9
SCORE_WEIGHTS = {"facts": 0.25, "inference": 0.45, "intent": 0.10, "contactability": 0.20}
SEVERITY = {"high": 0.8, "medium": 0.6, "low": 0.4, "info": 0.2}
MOST_CONFIDENCE, AI_RAISE, AI_ONLY_MOST, SOCIAL_CONFIDENCE, WEAK = 0.95, 0.15, 0.6, 0.3, 0.4


def exact(a: Column, b: Column) -> Column:
    return F.when((a != "") & (a == b), 1.0).otherwise(0.0)


def address_match(postal_a: Column, street_a: Column, postal_b: Column, street_b: Column) -> Column:
    """1 for the same postal code and street, 0.5 for the code alone."""
    return F.when(exact(postal_a, postal_b) == 1, F.when(exact(street_a, street_b) == 1, 1.0).otherwise(0.5)).otherwise(0.0)


def rate(n: Column, d: Column) -> Column:
    """n / d to 4 places; null unless d is positive."""
    return F.when(d > 0, F.round(n / d, 4))


def combine(confidences: Column) -> Column:
    """1 - product of (1 - c), each c held to 0..1, to 3 places and at most 0.95."""
    rest = F.aggregate(confidences, F.lit(1.0), lambda a, c: a * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))))
    return F.round(F.least(1 - rest, F.lit(MOST_CONFIDENCE)), 3)


def combined(confidence: Column) -> Column:
    """``combine`` as an aggregate over rows, with partial aggregation; 0 where none is known."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence.cast("double")))
    return F.round(F.least(1 - F.coalesce(F.product(1 - held), F.lit(1.0)), F.lit(MOST_CONFIDENCE)), 3)


def weighted(parts: dict[str, Column], weights: dict[str, float] = SCORE_WEIGHTS) -> Column:
    """Sum of the parts, each to 3 places, by weight; in decimals, so that the third place is exact, half up."""
    term = lambda k, v: F.lit(Decimal(str(weights[k]))) * F.round(v.cast("double"), 3).cast("decimal(6,3)")
    return F.round(reduce(lambda a, b: a + b, [term(k, v) for k, v in parts.items()]), 3).cast("double")


def facts(status: Column, website_kind: Column, audit_status: Column, industry: Column, city: Column, state: Column) -> Column:
    """Share of four things known for sure about a business."""
    open_now = F.when(status == "operational", 1.0).when(status == "closed_permanently", 0.0).otherwise(0.5)
    site = F.when((website_kind == "none") | audit_status.isin("done", "skipped"), 1.0).otherwise(0.0)
    trade = F.when((industry != "") & (industry != "other"), 1.0).otherwise(0.0)
    place = F.when((city != "") & (state != ""), 1.0).otherwise(0.0)
    return F.round((open_now + site + trade + place) / 4, 3)


def contactability(phone: Column, contact_form: Column, mailto: Column) -> Column:
    reached = F.coalesce(contact_form, F.lit(False)) | F.coalesce(mailto, F.lit(False))
    return F.when(phone != "", 0.5).otherwise(0.0) + F.when(reached, 0.5).otherwise(0.0)


def estimate_cost(tokens_in: Column, price_in: Column, tokens_out: Column, price_out: Column) -> Column:
    """Cost in decimals, to 6 places and half up; null without prices."""
    part = lambda n, p: n.cast("decimal(18,0)") * p.cast("decimal(12,6)") / F.lit(1_000_000).cast("decimal(7,0)")
    return F.round(part(tokens_in, price_in) + part(tokens_out, price_out), 6).cast("decimal(10,6)")


def backoff_seconds(base: Column, attempt: Column) -> Column:
    return F.pow(base, F.greatest(attempt, F.lit(1)))


def doubling_backoff(base: Column, attempt: Column) -> Column:
    return base * F.pow(F.lit(2), attempt - 1)


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days of 24 hours, rounded down (not calendar days)."""
    return F.floor((F.unix_timestamp(later) - F.unix_timestamp(earlier)) / 86400)
