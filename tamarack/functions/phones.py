"""Phone numbers of several numbering plans as E.164, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.functions import places

# Of a region its country code, international prefix, trunk prefix (blank: none) and what national numbers look like.
PLANS = {
    "GB": ("44", "00", "0", r"1\d{8,9}|[238]\d{9}|5[56]\d{8}|7\d{9}|9[018]\d{8}"),
    "DE": ("49", "00", "0", r"1[5-7]\d{8,9}|[2-9]\d{5,10}"),
    "FR": ("33", "00", "0", r"[1-9]\d{8}"),
    "ES": ("34", "00", "", r"[5-9]\d{8}"),
    "IT": ("39", "00", "", r"0\d{5,10}|3\d{8,9}"),
    "AU": ("61", "0011", "0", r"[23478]\d{8}|1[38]00\d{6}|13\d{4}"),
    "IN": ("91", "00", "0", r"[1-9]\d{9}"),
    "JP": ("81", "010", "0", r"[1-9]\d{8,9}"),
    "BR": ("55", "00", "0", r"[1-9]{2}9?[1-9]\d{7}"),
    "MX": ("52", "00", "", r"[1-9]\d{9}"),
}
NORTH_AMERICA = ("US", "CA")


def _own(digits: Column, region: str) -> Column:
    """A national number with or without its trunk prefix, as E.164; null for one that the plan does not have."""
    code, _, trunk, national = PLANS[region]
    number = F.regexp_extract(digits, rf"^(?:{trunk})?({national})$", 1)
    return F.when(number != "", F.concat(F.lit(f"+{code}"), number))


def to_e164(raw: Column, region: Column) -> Column:
    """E.164 of a number as written, read in a region (a country's two letters; null: US); null for what is no number of a known plan.

    A number with ``+`` or the region's international prefix is read by the plan of its country code, wherever it was written. Letters
    are not numbers; a trunk prefix in brackets after the country code is dropped. An unknown region knows international numbers only.
    """
    where = F.upper(F.coalesce(region, F.lit("US")))
    text = F.trim(raw)
    digits = F.regexp_replace(text, r"\D", "")
    plus = text.startswith("+")
    abroad = F.when(plus, digits)
    for name, (_, prefix, _, _) in PLANS.items():
        abroad = F.coalesce(abroad, F.when((where == name) & digits.startswith(prefix), F.substring(digits, len(prefix) + 1, 32)))
    abroad = F.coalesce(abroad, F.when(where.isin(*NORTH_AMERICA) & digits.startswith("011"), F.substring(digits, 4, 32)))
    # country codes are free of prefixes, so at most one plan reads a number
    read = [F.when(abroad.startswith(code), _own(F.substring(abroad, len(code) + 1, 32), name)) for name, (code, _, _, _) in PLANS.items()]
    home = [F.when(where == name, _own(digits, name)) for name in PLANS]
    american = F.when(abroad.isNotNull(), F.when(abroad.startswith("1"), places.to_e164(abroad))).when(where.isin(*NORTH_AMERICA), places.to_e164(raw))
    lettered = text.rlike(r"\p{L}")
    return F.when(~lettered, F.coalesce(american, F.when(abroad.isNotNull(), F.coalesce(*read)).otherwise(F.coalesce(*home))))
