"""Column expressions over what a fetch brings back: header lists, redirects, failures."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X
from . import urls as U

MOST_HOPS = 10  # fixed value


def headers(pairs) -> Column:
    """map of lower-case names from array<struct<name,value>> in order of arrival; repeats are joined with a comma, those
    of X-Robots-Tag with a line break, since each of its lines names its own crawler.  Null values are left out."""
    known = F.filter(F.coalesce(X.col(pairs), F.expr("cast(array() as array<struct<name:string,value:string>>)")), lambda h: h["name"].isNotNull() & h["value"].isNotNull())
    named = F.transform(known, lambda h: F.struct(F.lower(h["name"]).alias("name"), F.trim(h["value"]).alias("value")))

    def joined(name: Column) -> Column:
        values = F.transform(F.filter(named, lambda h: h["name"] == name), lambda h: h["value"])
        return F.when(name == "x-robots-tag", F.array_join(values, "\n")).otherwise(F.array_join(values, ", "))

    names = F.array_distinct(F.transform(named, lambda h: h["name"]))
    return F.map_from_arrays(names, F.transform(names, joined))


def redirect_error(hops, target, origin_host, allowed) -> Column:
    """Why a redirect is not followed, null if it may be: too many hops, another scheme or host, or a path that robots rules forbid."""
    out = ~F.coalesce(U.scheme_of(target).isin("http", "https") & (U.host_of(target) == X.col(origin_host)), F.lit(False))
    return (
        F.when(X.col(hops) > MOST_HOPS, "error: too many redirects").when(out, "external_redirect_blocked")
        .when(~F.coalesce(X.col(allowed), F.lit(True)), "redirect_blocked_by_robots"))


def failure(kind, reason) -> Column:
    """tls_fail, dns_fail, timeout or the reason itself, from the name of the exception's class; null without one."""
    k = X.col(kind)
    return (
        F.when(k.isNull(), F.lit(None).cast("string")).when(k.startswith("SSL"), "tls_fail").when(k == "gaierror", "dns_fail")
        .when(k.isin("timeout", "TimeoutError"), "timeout").otherwise(F.concat(F.lit("error: "), F.coalesce(X.col(reason), F.lit("")))))
