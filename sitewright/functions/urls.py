"""URLs as column expressions: split by the generic pattern of RFC 3986, which takes any string (parse_url is strict)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import contracts as C
from .text import col, collapse, falsy

PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def part(c, number: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty if absent."""
    return F.regexp_extract(col(c), PARTS, number)


def scheme_of(c) -> Column:
    return F.lower(part(c, 1))


def host_of(c) -> Column:
    """Authority in lower case, with port and user."""
    return F.lower(part(c, 2))


def path_of(c) -> Column:
    return falsy(part(c, 3), "/")


def target_of(c) -> Column:
    """What robots rules are matched with: path and query."""
    return F.concat(path_of(c), F.when(part(c, 4) != "", F.concat(F.lit("?"), part(c, 4))).otherwise(""))


def normalize(c) -> Column:
    """Without the fragment, scheme and host in lower case, / for an empty path."""
    start = F.when(scheme_of(c) != "", F.concat(scheme_of(c), F.lit(":"))).otherwise("")
    return F.concat(start, F.lit("//"), host_of(c), target_of(c))


def is_page(c) -> Column:
    return ~F.lower(part(c, 3)).rlike(r"\.(?:" + "|".join(C.ASSET_SUFFIXES) + r")\z")


def first_segment(c) -> Column:
    return F.regexp_extract(part(c, 3), r"^/([^/]+)", 1)


def safe_host(c) -> Column:
    """A host as a file name."""
    return falsy(F.regexp_replace(col(c), r'[:*?"<>|\\/]', "_"), "site")


def alternate_host(c) -> Column:
    """The host with or without www., null where that makes no sense."""
    bare = F.regexp_replace(col(c), r":[0-9]+\z", "")
    none = (bare == "localhost") | bare.rlike(r"^[0-9.]+\z") | bare.startswith("[") | ~bare.contains(".")
    return F.when(~none, F.when(col(c).startswith("www."), F.substr(col(c), F.lit(5))).otherwise(F.concat(F.lit("www."), col(c))))


def bare_domain(c) -> Column:
    """Host of a URL or bare name: lower case, without www., port and final dot."""
    t = F.lower(collapse(c))
    host = F.when(t.contains("://"), host_of(t)).otherwise(F.regexp_extract(t, r"^([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(host, r":[0-9]+\z", ""), r"^www\.|\.\z", "")


def is_ours(domain, ours) -> Column:
    d, o = bare_domain(domain), bare_domain(ours)
    return (d == o) | d.endswith(F.concat(F.lit("."), o))


def clean_url(c) -> Column:
    """A URL as people paste it: wrappers and a final full stop removed, https assumed; null unless its host is a name."""
    t = F.regexp_replace(F.regexp_replace(collapse(c), r"^[<(\[\"']+|[>)\]\"']+\z", ""), r"[.,)]+\z", "")
    full = F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), t).otherwise(F.concat(F.lit("https://"), t))
    name = F.regexp_replace(F.regexp_replace(host_of(full), r"^.*@", ""), r":[0-9]+\z", "")
    good = scheme_of(full).isin("http", "https") & name.rlike(r"^[^\s.]+(?:\.[^\s.]+)*\.[^\s.]{2,}\z") & ~full.rlike(r"\s")
    return F.when(good, F.concat(scheme_of(full), F.lit("://"), host_of(full), part(full, 3), F.when(part(full, 4) != "", F.concat(F.lit("?"), part(full, 4))).otherwise("")))


def segment_label(c) -> Column:
    """A path segment as words."""
    return collapse(F.regexp_replace(F.try_url_decode(F.regexp_replace(col(c), r"\+", " ")), r"[-_+]+", " "))


def slug(c) -> Column:
    """A readable file name with twelve digits of the normalised URL's hash."""
    path = F.coalesce(F.try_url_decode(F.regexp_replace(part(c, 3), r"\+", " ")), part(c, 3))
    words = F.regexp_replace(F.regexp_replace(F.lower(path), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+\z", "")
    return F.concat(falsy(F.substring(words, 1, 54), "index"), F.lit("-"), F.substring(F.sha2(normalize(c), 256), 1, 12))
