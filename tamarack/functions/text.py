"""Names and text: display form, normal form, phonetic key, fuzzy ratio, verbatim comparison.

Built-in expressions wherever Spark has them. Three steps have no built-in form and run as Arrow-batched
pandas UDFs: Unicode decomposition, the phonetic key and the token-set ratio. Null in, null out.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

# Legal suffixes dropped from the end of a name.
LEGAL_SUFFIXES = ("llc", "l l c", "inc", "incorporated", "co", "company", "corp", "corporation", "ltd", "limited", "pllc", "plc", "lp", "llp", "pc")


def display_name(raw: Column) -> Column:
    """Whitespace of any kind collapsed and trimmed; nothing left is null."""
    return F.nullif(F.trim(F.regexp_replace(raw, r"(?U)\s+", " ")), F.lit(""))


@pandas_udf(StringType())
def _unaccented(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def strip_legal_suffixes(name: Column) -> Column:
    """All trailing legal suffixes go, but never the whole name."""
    words = "|".join(sorted(LEGAL_SUFFIXES, key=len, reverse=True))
    return F.regexp_replace(name, rf"(?<=\S)(?: (?:{words}))+$", "")


def normalize_name(raw: Column) -> Column:
    """Lower case, without accents and punctuation, ``&`` as ``and``, without legal suffixes."""
    x = F.replace(_unaccented(F.lower(display_name(raw))), F.lit("&"), F.lit(" and "))
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"(?U)[^\w\s]|_", " "), r"(?U)\s+", " "))
    return F.nullif(strip_legal_suffixes(x), F.lit(""))


_VOWELS = set("aeiou")


@lru_cache(1 << 16)
def metaphone(word: str) -> str:
    """The classic metaphone code of one word of ASCII letters, by the published rules."""
    w = re.sub(r"(.)\1+", lambda m: m[0] if m[1] == "c" else m[1], "".join(c for c in word.lower() if "a" <= c <= "z"))
    if not w:
        return ""
    if w[:2] in ("kn", "gn", "pn", "wr", "ae"):
        w = w[1:]
    elif w[0] == "x":
        w = "s" + w[1:]
    elif w[:2] == "wh":
        w = "w" + w[2:]
    out, i, n = [], 0, len(w)
    at = lambda k: w[k] if 0 <= k < n else ""
    while i < n:
        c, after = w[i], at(i + 1)
        if c in _VOWELS:
            if i == 0:
                out.append(c.upper())
        elif c == "b":
            if not (i == n - 1 and at(i - 1) == "m"):
                out.append("B")
        elif c == "c":
            if after == "i" and at(i + 2) == "a" or after == "h" and at(i - 1) != "s":
                out.append("X")
                i += after == "h"
            elif after in ("i", "e", "y"):
                if at(i - 1) != "s":
                    out.append("S")
            else:
                out.append("K")
                i += after == "h"
        elif c == "d":
            if after == "g" and at(i + 2) in ("e", "y", "i"):
                out.append("J")
                i += 2
            else:
                out.append("T")
        elif c == "g":
            if after == "h":
                if i == 0 or at(i - 1) in _VOWELS and at(i + 2) in _VOWELS:
                    out.append("K")
                    i += 1
                elif not (i + 2 == n or at(i + 2) not in _VOWELS):
                    out.append("K")
            elif after == "n" and (i + 2 == n or w[i + 2 :] == "ed"):
                pass
            elif after in ("i", "e", "y") and at(i - 1) != "g":
                out.append("J")
            else:
                out.append("K")
        elif c == "h":
            if after in _VOWELS and at(i - 1) not in ("c", "s", "p", "t", "g"):
                out.append("H")
        elif c == "k":
            if at(i - 1) != "c":
                out.append("K")
        elif c == "p":
            out.append("F" if after == "h" else "P")
            i += after == "h"
        elif c == "q":
            out.append("K")
        elif c == "s":
            if after == "h" or after == "i" and at(i + 2) in ("o", "a"):
                out.append("X")
                i += after == "h"
            else:
                out.append("S")
        elif c == "t":
            if after == "i" and at(i + 2) in ("o", "a"):
                out.append("X")
            elif after == "h":
                out.append("0")
                i += 1
            elif not (after == "c" and at(i + 2) == "h"):
                out.append("T")
        elif c == "v":
            out.append("F")
        elif c in ("w", "y"):
            if after in _VOWELS:
                out.append(c.upper())
        elif c == "x":
            out.append("KS")
        elif c == "z":
            out.append("S")
        elif c in "fjlmnr":
            out.append(c.upper())
        i += 1
    return "".join(out)


@pandas_udf(StringType())
def name_key(s: pd.Series) -> pd.Series:
    """Phonetic blocking key of a whole normalised name."""
    return s.map(lambda x: (" ".join(filter(None, map(metaphone, x.split()))) or None) if x else None)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, on bit rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200 * _common(a, b) / (len(a) + len(b))


def token_set(a: str | None, b: str | None) -> float:
    """Best ratio of shared words, and of shared words with either rest; 0 if a side has no words."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both, one, two = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not one or not two):
        return 100.0
    # both rests stand after the same words, so only what the rests share is searched for
    n = len(both) + 1 if both else 0
    left, right = n + len(one), n + len(two)
    whole = 200 * (n + _common(one, two)) / (left + right)
    return max(whole, 200 * len(both) / (len(both) + min(left, right))) if both else whole


@pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def verbatim(text: Column) -> Column:
    """Key for verbatim comparison: curly quotes and dashes folded, whitespace collapsed, lower case."""
    folded = F.translate(text, "‘’“”–—", "''\"\"--")
    return F.lower(F.trim(F.regexp_replace(folded, r"(?U)\s+", " ")))


def contains_quote(corpus: Column, quote: Column) -> Column:
    """Whether a text of the array ``corpus`` holds ``quote`` verbatim; an empty quote is in none."""
    needle = verbatim(quote)
    return F.coalesce((needle != "") & F.exists(corpus, lambda t: F.contains(verbatim(t), needle)), F.lit(False))


def clip(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last an ellipsis if anything was cut."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))).otherwise(text)


def humanize(code: Column) -> Column:
    """``a_code`` as ``A code``."""
    plain = F.replace(code, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, 2, 1 << 20))


def split_suffix(text: Column, suffix: Column) -> Column:
    """``text`` without a trailing ``suffix``, trimmed; null if nothing is left."""
    cut = F.when(F.coalesce(suffix, F.lit("")) == "", text).when(text.endswith(suffix), F.left(text, F.length(text) - F.length(suffix))).otherwise(text)
    return F.nullif(F.trim(cut), F.lit(""))
