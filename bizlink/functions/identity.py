"""How a business is recognised: normalised names, phone keys, hosts, blanks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about identity (fixed values).
NAME_STOPWORDS = "the|inc|llc|ltd|co|company|corp|plc|group"


def normalize_name(name: Column) -> Column:
    """Lower case, legal words dropped, letters and digits only."""
    bare = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), rf"\b({NAME_STOPWORDS})\b", "")
    return F.regexp_replace(bare, "[^a-z0-9]", "")


def spaced_name(name: Column) -> Column:
    """Lower case, other characters as spaces, trimmed: the form for token ratios."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9\s]", ""))


def digits(phone: Column) -> Column:
    return F.regexp_replace(F.coalesce(phone, F.lit("")), r"(?U)\D", "")


def phone_key(phone: Column) -> Column:
    """Last seven digits for the ledger and the queue, null below seven."""
    d = digits(phone)
    return F.when(F.length(d) >= 7, F.right(d, F.lit(7)))


def match_digits(phone: Column) -> Column:
    """Last seven of whatever digits there are, null if none: the form linkage compares."""
    d = digits(phone)
    return F.when(d != "", F.right(d, F.lit(7)))


def name_key(name: Column) -> Column:
    n = normalize_name(name)
    return F.when(n != "", n)


def filled(c: Column) -> Column:
    """Not null and not empty."""
    return F.coalesce(c != "", F.lit(False))


def is_blank(c: Column, kind: str) -> Column:
    """The merge's idea of no value: null, empty text, zero, false."""
    empty = {"string": "", "boolean": False}.get(kind, 0)
    return c.isNull() | (c == F.lit(empty))


def host(url: Column) -> Column:
    """Host of a web address without ``www.`` and port; addresses without a scheme count."""
    full = F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("http://"), url))
    name = F.regexp_extract(F.lower(full), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(name, r"^www\.", "")


def slug(c: Column, most: int = 40) -> Column:
    """Letters and digits joined by underscores, at most ``most`` long, else ``leads``."""
    s = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    s = F.regexp_replace(F.substring(s, 1, most), "^_+|_+$", "")
    return F.when(s == "", "leads").otherwise(s)
