"""Measurement and drift reports: the tables of a period, their document, and the comparison of two."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import diff as D
from ..operators import measure as M


def tables(log: DataFrame, queries: DataFrame, host: str, since: str | None = None, until: str | None = None, cumulative: bool = False) -> dict[str, DataFrame]:
    """All tables of a report from a log that is already last-wins.  The selected rows are persisted once for all of them;
    the trend takes every date, the rest the last one unless cumulative."""
    rows = M.known(log, queries, since, until).persist()
    good = rows.where("compatible")
    chosen = M.latest(good, cumulative)
    return {
        "engines": M.slots(chosen), "any_cited": M.any_cited(chosen), "queries": M.by_query(chosen, queries), "top_urls": M.top_urls(chosen), "ours": M.our_urls(chosen, host),
        "competitors": M.competitors(chosen, host), "cohorts": M.cohorts(chosen), "cohort_queries": M.cohort_queries(chosen), "trend": M.trend(good), "trend_engines": M.trend_engines(good),
        "quality": M.quality(rows), "conditions": M.conditions(chosen), "totals": M.totals(M.slots(chosen)), "query_set": queries.agg(X.set_fingerprint("fingerprint").alias("fingerprint")),
    }


def document(parts: dict[str, DataFrame], host: str, cumulative: bool) -> dict:
    """The small tables as one JSON document."""
    rows = lambda name: [r.asDict(recursive=True) for r in parts[name].collect()]
    names = ("engines", "any_cited", "queries", "top_urls", "ours", "competitors", "cohorts", "trend", "trend_engines", "totals")
    return {"schema": "sitewright/measure/2", "host": host, "window": {"scope": "cumulative" if cumulative else "latest"}, "query_set": rows("query_set")[0], "quality": rows("quality")[0], "conditions": rows("conditions")[0]} | {n: rows(n) for n in names}


def summary_row(parts: dict[str, DataFrame], cumulative: bool) -> DataFrame:
    """What comparability is judged by: one row.  A condition's queries are counted per query, so runs must match."""
    one = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in M.COHORT], "query_id", "runs", "attempts")
    cohorts = parts["cohort_queries"].agg(F.array_sort(F.collect_list(one)).alias("cohorts"))
    row = cohorts.crossJoin(F.broadcast(parts["query_set"])).crossJoin(F.broadcast(parts["quality"]))  # one row each
    return row.select("cohorts", "fingerprint", "errors", "unmeasured", "incompatible_rows", "regression_eligible", F.lit(cumulative).alias("cumulative"))


def drift(before: dict[str, DataFrame], after: dict[str, DataFrame], cumulative: tuple[bool, bool] = (False, False)) -> dict[str, DataFrame]:
    """Comparison of two reports; a rate change counts only if the two may be compared at all."""
    may = D.comparable(summary_row(before, cumulative[0]), summary_row(after, cumulative[1]))
    rates = M.significance(before["totals"], after["totals"], ["type"]).crossJoin(F.broadcast(may.select("comparable")))
    verdict = F.when(F.col("comparable") | (F.col("verdict") == "not_measured"), F.col("verdict")).otherwise("inconclusive")
    return {
        "comparable": may, "rates": rates.withColumn("verdict", verdict), "ours": D.count_diff(before["ours"], after["ours"], "url"),
        "competitors": D.count_diff(before["competitors"], after["competitors"], "domain", 20),
        "engines": D.engine_points(*[t["engines"].groupBy("engine").agg(F.sum("cited").alias("c"), F.sum("runs").alias("r")).select("engine", X.ratio("c", "r").alias("rate")) for t in (before, after)]),
    }
