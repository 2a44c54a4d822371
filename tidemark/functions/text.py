"""Name, URL and text functions as Column expressions (JVM only)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _folds() -> dict[str, str]:
    """Lower-case letters of the Latin blocks whose compatibility decomposition is one ASCII letter with marks, and that letter."""
    out = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii() and chr(code).islower():
            out[chr(code)] = plain
    return out


ACCENTED, PLAIN = ("".join(x) for x in zip(*_folds().items()))


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def normalize_name(text: Column, cap: int = 40) -> Column:
    """Letters and digits only, folded, capped."""
    return F.substring(F.regexp_replace(fold(text), "[^a-z0-9]", ""), 1, cap)


def spaced_name(text: Column, cap: int = 25) -> Column:
    """Folded words with single spaces, capped."""
    return F.substring(F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " ")), 1, cap)


_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
_AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"


def authority(url: Column) -> Column:
    """User, host and port as written; empty without `//`."""
    return F.regexp_extract(url, _AUTHORITY, 1)


def host(url: Column) -> Column:
    """Host of a URL, lower case, without user, port and www; empty without `//`."""
    return F.regexp_replace(F.lower(F.regexp_extract(authority(url), r"^(?:.*@)?([^:]*)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    """Path of a URL; without `//`, what stands before query and fragment."""
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def scheme(url: Column) -> Column:
    """Scheme in lower case, https if there is none."""
    found = F.lower(F.regexp_extract(url, _SCHEME, 1))
    return F.when(found == "", F.lit("https")).otherwise(found)


def normalized_url(url: Column) -> Column:
    """Scheme, host without www, ports but 80 and 443, path without trailing slashes, query; no fragment."""
    url = F.trim(url)
    port = F.regexp_extract(authority(url), r":(\d+)$", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    shown = F.when((port == "") | port.isin("80", "443"), F.lit("")).otherwise(F.concat(F.lit(":"), port))
    bare = F.regexp_replace(path(url), "/+$", "")
    bare = F.when(bare.rlike("^[^/]"), F.concat(F.lit("/"), bare)).otherwise(bare)
    return F.concat(scheme(url), F.lit("://"), host(url), shown, bare, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def hit_key(url: Column) -> Column:
    """Scheme, host without www, path without trailing slashes (/ if empty); no port, query or fragment."""
    url = F.trim(url)
    bare = F.regexp_replace(path(url), "/+$", "")
    return F.concat(scheme(url), F.lit("://"), host(url), F.when(bare == "", F.lit("/")).otherwise(bare))


def listed_key(url: Column) -> Column:
    """Scheme (https where none is written), user, host without www and port, path without trailing slashes; null without a host."""
    raw = F.trim(url)
    none = F.lower(raw).isin("", "null", "none", "n/a", "-", "undefined")
    whole = F.when(F.contains(raw, F.lit("://")), raw).otherwise(F.concat(F.lit("https://"), raw))
    at = F.lower(authority(whole))
    key = F.concat(scheme(whole), F.lit("://"), F.regexp_replace(at, r"^www\.", ""), F.regexp_replace(path(whole), "/+$", ""))
    return F.when(~none & (at != ""), key)


def list_like_score(chunk: Column, pattern: str) -> Column:
    """How much a chunk looks like a list: pattern hits and decimal numbers, at most 1."""
    hits, numbers = F.size(F.regexp_extract_all(chunk, F.lit(f"(?i)({pattern})"), F.lit(0))), F.size(F.regexp_extract_all(chunk, F.lit(r"(\d+\.\d+)"), F.lit(0)))
    return F.least(F.lit(1.0), hits * 0.18 + F.least(numbers, F.lit(6)) * 0.06)


def url_key(url: Column) -> Column:
    """Host and path without a trailing slash."""
    return F.concat(host(url), F.regexp_replace(path(url), "/+$", ""))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays' distinct values; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda t: t != ""))
