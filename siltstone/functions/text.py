"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: Query parameters that only track where a visitor came from (fixed values).
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")


def normalize_text(c: Column) -> Column:
    """One space for runs of blanks, LF line ends, each line stripped, at most one empty line, stripped."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t\f\x0B\x{A0}]+", " "), " ?\n ?", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({TOKEN})"), F.lit(1))


def token_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(c) + 3) / 4)).cast("bigint")


def compact(c: Column, max_tokens: int) -> Column:
    """Head, middle and tail of a text too long for an embedding model (4 characters a token)."""
    budget = 4 * max_tokens
    head, middle, tail = budget * 2 // 5, budget * 2 // 5, budget // 5
    start = (F.floor((F.length(c) - middle) / 2) + 1).cast("int")
    parts = F.concat(c.substr(F.lit(1), F.lit(head)), F.lit("\n…\n"), c.substr(start, F.lit(middle)), F.lit("\n…\n"), F.right(c, F.lit(tail)))
    return F.when(F.length(c) > budget, parts).otherwise(c)


def redact(c: Column, limit: int = 1000) -> Column:
    """A message without control characters and credentials, on one line, cut to a limit."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    c = F.regexp_replace(strip(c), r"(?i)\bbearer\s+[a-z0-9._~+/=-]+", "Bearer [REDACTED]")
    c = F.regexp_replace(c, r"(?i)\b(password|api[_-]?key|key|token|secret|authorization|cookie|csrf)(\s*[:=]\s*)([^\s,;&#]+)", "$1$2[REDACTED]")
    return F.substring(F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " ")), 1, limit)


def is_safe_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^(?i:https?)://[^/?#]+"), F.lit(False))


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encoded(c: Column) -> Column:
    """Percent encoding that leaves letters, digits and ``_.-~`` as they are."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(c: Column) -> Column:
    """Lower-case scheme and host, no user, trailing slash, tracking parameters or fragment.

    Query parameters are decoded, sorted by key and value, and encoded again; one without a value
    has an empty one.  Null for anything but an absolute http or https address.
    """
    c = strip(c)
    whole = r"^([A-Za-z]+)://(?:[^/?#@]*@)?([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    part = lambda i: F.regexp_extract(c, whole, i)
    path = F.regexp_replace(part(3), "/+$", "")
    pairs = F.transform(F.filter(F.split(part(4), "&"), lambda p: p != ""), lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.regexp_extract(p, "^[^=]*=?(.*)$", 1)).alias("v")))
    sorted_ = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING)))
    query = F.array_join(F.transform(sorted_, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    url = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(is_safe_url(c), url)


def tag_list(c: Column) -> Column:
    """``<a><b>`` to its tags, trimmed, without blanks."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit("<([^<>]+)>"), F.lit(1)), lambda x: F.trim(x)), lambda t: t != "")


@F.pandas_udf(ArrayType(StringType()))
def _folded(tags: pd.Series) -> pd.Series:
    """Composed (NFC), stripped and case-folded; no built-in function does this."""
    return tags.map(lambda ts: None if ts is None else [None if t is None else unicodedata.normalize("NFC", t).strip().casefold() for t in ts])


def normalize_tags(tags: Column, limit: int = 100) -> Column:
    """Composed, stripped, case-folded, cut, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(_folded(tags), lambda t: F.substring(t, 1, limit)), lambda t: t != "")))


def html_strip(c: Column) -> Column:
    """The text of simple HTML by patterns alone: no scripts, styles, comments or tags."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", " "))


def code_blocks(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?is)```(?:python)?\s*(.*?)```"), F.lit(1)), lambda x: F.trim(x))


def fence(code: Column) -> Column:
    """A fence longer than any run of back-ticks in the code, three at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(code, F.lit("(`+)"), F.lit(1)), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name; namespace is a UUID in hexadecimal without dashes."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1, 4).substr((F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-5"), h.substr(14, 3), F.lit("-"), variant, h.substr(18, 3), F.lit("-"), h.substr(21, 12))


def escape_citations(c: Column) -> Column:
    return F.regexp_replace(c, r"\[(\d{1,4})\]", "〔$1〕")


def cited(c: Column, n_sources: Column) -> tuple[Column, Column]:
    """The valid and the invalid citation numbers ``[n]`` of an answer, sorted and distinct."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d{1,4})\]"), F.lit(1)), lambda x: x.cast("int"))))
    valid = lambda x: (x >= 1) & (x <= n_sources)
    return F.filter(found, valid), F.filter(found, lambda x: ~valid(x))


def without_invalid(c: Column, n_sources: Column) -> Column:
    """An answer without the citations ``[n]`` of no source, and without the blanks that they leave at line ends."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\[(\d{1,4})\]"), F.lit(1)))
    invalid = F.filter(found, lambda x: (x.cast("int") < 1) | (x.cast("int") > n_sources))
    left = F.aggregate(invalid, c, lambda text, x: F.replace(text, F.concat(F.lit("["), x, F.lit("]")), F.lit("")))
    return strip(F.regexp_replace(left, r"[ \t]+\n", "\n"))


def snippet(c: Column, terms: Column, size: int) -> Column:
    """At most ``size`` characters of the stripped text around the first of the terms (longer than 1), with ellipses."""
    c = strip(c)
    low = F.lower(c)
    places = F.filter(F.transform(F.filter(terms, lambda t: F.length(t) > 1), lambda t: F.instr(low, F.lower(t))), lambda p: p > 0)
    centre = F.coalesce(F.array_min(places), F.lit(1)) - 1
    start = F.greatest(F.lit(0), centre - size // 3)
    cut = F.trim(c.substr((start + 1).cast("int"), F.lit(size)))
    shown = F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(start + size < F.length(c), "…").otherwise(""))
    return F.when(F.length(c) <= size, c).otherwise(shown)


def sigmoid_score(x: Column) -> Column:
    """A score within 0 and 1 as it is, any other through a clamped logistic function."""
    z = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), x))
    return F.when(x.between(0, 1), x).otherwise(1 / (1 + F.exp(-z)))
