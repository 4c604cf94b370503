"""Hosts, domains and website kinds, in built-in expressions."""

from __future__ import annotations

import unicodedata
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType

# Registered domains whose subdomains belong to different businesses.
BUILDER_DOMAINS = (
    "wixsite.com", "square.site", "godaddysites.com", "business.site", "weebly.com", "webflow.io", "carrd.co", "wixstudio.com",
    "editorx.io", "weeblysite.com", "squarespace.com", "wordpress.com", "mystrikingly.com", "jimdosite.com", "site123.me", "myshopify.com",
)
# Platforms whose profiles are never an identity.
SOCIAL_DOMAINS = ("facebook.com", "fb.com", "instagram.com", "linktr.ee", "yelp.com", "nextdoor.com", "x.com", "twitter.com", "tiktok.com", "linkedin.com")
#: Public suffixes known here: top-level domains, and those with a second level. No list is installed; pass a fuller one where it matters.
SUFFIXES = ("com", "org", "net", "edu", "gov", "io", "co", "us", "me", "biz", "info", "site", "app", "dev", "ee", "de", "fr", "es", "uk", "ca", "au")
SECOND_LEVEL = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "com.mx")


def host_of(url: Column) -> Column:
    """Lower-case host without ``www.``, port and final dot; null without a dot in it."""
    text = F.trim(url)
    rest = F.regexp_extract(F.when(F.contains(text, F.lit("//")), text).otherwise(F.concat(F.lit("https://"), text)), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(rest), r"\.+$", ""), r"^www\.", "")
    return F.when(F.contains(F.lower(rest), F.lit(".")), F.nullif(host, F.lit("")))


# Signs that the mapping drops, full stops of other scripts, signs that stay though they fold to others.
DROPPED = "\u00ad\u034f\u180b\u180c\u180d\u200b\u2060\u2064\ufeff" + "".join(map(chr, range(0xFE00, 0xFE10)))
STOPS = "\u3002\uff0e\uff61"
KEPT = "\u00df\u03c2\u200c\u200d"
# Signs that are valid, or not, whatever their category says.
VALID = "\u00df\u03c2\u06fd\u06fe\u0f0b\u3007"
INVALID = "\u0640\u07fa\u302e\u302f\u3031\u3032\u3033\u3034\u3035\u303b"
#: Categories of letters, marks and digits, of which labels are made.
_LABEL_KINDS = ("Ll", "Lo", "Lm", "Mn", "Mc", "Nd")


def _mapped(host: str) -> str:
    """Small letters and plain forms; dropped signs gone, all full stops one."""
    signs = ("." if c in STOPS else c if c in KEPT else "" if c in DROPPED else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold()) for c in host)
    return unicodedata.normalize("NFC", "".join(signs))


def _in_place(label: str, i: int) -> bool:
    """Whether a sign that is valid in some surroundings only stands in these."""
    c, before, after = label[i], label[:i], label[i + 1 :]
    if c in "\u200c\u200d":
        return bool(before) and unicodedata.combining(before[-1]) == 9
    if c == "\u00b7":
        return before.endswith("l") and after.startswith("l")
    if c == "\u0375":
        return bool(after) and unicodedata.name(after[0], "").startswith("GREEK")
    if c in "\u05f3\u05f4":
        return bool(before) and unicodedata.name(before[-1], "").startswith("HEBREW")
    if c == "\u30fb":
        return any(unicodedata.name(x, "").startswith(("HIRAGANA", "KATAKANA LETTER", "CJK UNIFIED")) for x in label)
    return False


def _valid(label: str) -> bool:
    if not label or label[0] == "-" or label[-1] == "-" or label[2:4] == "--" or unicodedata.category(label[0]).startswith("M"):
        return False
    for i, c in enumerate(label):
        plain = c == "-" or c in VALID or c not in INVALID and unicodedata.category(c) in _LABEL_KINDS and unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold()) == c
        if not plain and not _in_place(label, i):
            return False
    arabic, eastern = (any(low <= c <= chr(ord(low) + 9) for c in label) for low in ("\u0660", "\u06f0"))
    return not (arabic and eastern)


def _label(label: str) -> str | None:
    if label.startswith("xn--"):
        try:
            told = label[4:].encode("ascii").decode("punycode")
        except (UnicodeError, ValueError):
            return None
        return label if told and not told.isascii() and _mapped(told) == told and _valid(told) else None
    if not _valid(label):
        return None
    return label if label.isascii() else "xn--" + label.encode("punycode").decode("ascii")


def _ascii(host: str | None) -> str | None:
    if not host or not host.strip():
        return None
    labels = [_label(x) for x in _mapped(host.strip()).removesuffix(".").split(".")]
    if None in labels or any(len(x) > 63 for x in labels):
        return None
    return whole if len(whole := ".".join(labels)) <= 253 else None


@pandas_udf(StringType())
def ascii_host(s: pd.Series) -> pd.Series:
    """A host in ASCII, by the rules of 2008 after mapping to small letters and plain forms; null for one that has no such form.

    Sharp s and final sigma stay letters of their own. Labels of signs other than letters, marks, digits and hyphens are
    invalid, as are hyphens at the ends or third and fourth, and joiners out of place. Writing directions are not checked.
    """
    return s.map(_ascii)


def _allowed(body: str | None, url: str | None, agent: str = "*") -> bool:
    rules = RobotFileParser()
    rules.parse((body or "").splitlines())
    return rules.can_fetch(agent, url or "/")


@pandas_udf(BooleanType())
def robots_allows(body: pd.Series, url: pd.Series) -> pd.Series:
    """Whether the rules of a robots.txt let anyone read a URL; no rules allow all."""
    return pd.Series([_allowed(b, u) for b, u in zip(body, url, strict=True)], dtype=bool)


def registered_domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES, second: tuple[str, ...] = SECOND_LEVEL) -> Column:
    """The label before the longest known public suffix, with it; null for an unknown suffix."""
    ends = "|".join(s.replace(".", r"\.") for s in (*second, *suffixes))
    return F.nullif(F.regexp_extract(host, rf"([^.]+\.(?:{ends}))$", 1), F.lit(""))


def builder_host(url: Column) -> Column:
    """The host of a website builder's subdomain, else null."""
    host = host_of(url)
    ends = "|".join(b.replace(".", r"\.") for b in BUILDER_DOMAINS)
    return F.when(host.rlike(rf"\.(?:{ends})$"), host)


def clean_url(url: Column) -> Column:
    """Scheme, host and path as given, without query and fragment; blank is null."""
    return F.nullif(F.regexp_replace(F.trim(url), "[?#][\\s\\S]*$", ""), F.lit(""))


def page_key(url: Column) -> Column:
    """Host and path that two URLs of one page share: without scheme, ``www.``, final slashes, query and fragment; null without a host."""
    path = F.regexp_extract(clean_url(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/]*(/.*)?$", 1)
    return F.concat(host_of(url), F.regexp_replace(F.lower(path), "/+$", ""))


def parse_website(url: Column) -> Column:
    """{website, domain, kind}: kind is none, own_site, builder_subdomain or social_profile."""
    host = host_of(url)
    registered = registered_domain(host)
    kind = F.when(host.isNull(), "none").when(registered.isin(*SOCIAL_DOMAINS), "social_profile").when(registered.isin(*BUILDER_DOMAINS), "builder_subdomain").otherwise("own_site")
    domain = F.when(kind == "social_profile", None).when(kind == "builder_subdomain", host).otherwise(F.coalesce(registered, host))
    return F.struct(F.when(host.isNotNull(), clean_url(url)).alias("website"), domain.alias("domain"), kind.alias("kind"))
