"""Comparisons of two states: findings, stats, pages, lanes, engines, URLs, domains, metrics, snapshots."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import text as X


def pairs(before: DataFrame, after: DataFrame, by: list[str], value: str) -> DataFrame:
    """Full outer join on by: value_before, value_after."""
    return before.select(*by, F.col(value).alias("before")).join(after.select(*by, F.col(value).alias("after")), by, "full_outer")


def findings_by_code(findings: DataFrame, order: str = "pos") -> DataFrame:
    """One row a code: lane and severity of its first finding, URLs counted."""
    first = F.min_by(F.struct("lane", "severity"), F.col(order))
    return findings.groupBy("code").agg(first.alias("f"), F.sum(F.size("urls")).alias("urls")).select("code", "f.lane", "f.severity", "urls")


def finding_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """code, state: resolved, new or persisting, with the URL counts."""
    b = before.select("code", F.col("severity").alias("severity_before"), F.col("urls").alias("urls_before"))
    a = after.select("code", F.col("severity").alias("severity_after"), F.col("urls").alias("urls_after"))
    state = F.when(F.col("severity_after").isNull(), "resolved").when(F.col("severity_before").isNull(), "new").otherwise("persisting")
    return b.join(a, "code", "full_outer").withColumn("state", state)


def stats_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, value) tables: change of each key of either."""
    return pairs(before, after, ["key"], "value").withColumn("change", F.col("after") - F.col("before"))


def page_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """url, state: gone or new among pages with status 200."""
    b, a = (t.where("status = 200").select("url").distinct() for t in (before, after))
    return b.join(a, "url", "left_anti").withColumn("state", F.lit("gone")).unionByName(a.join(b, "url", "left_anti").withColumn("state", F.lit("new")))


def lane_diff(lanes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """All lanes in order with both states (na if missing) and whether the rank rose."""
    rank = lambda c: F.coalesce(*[F.when(F.col(c) == k, v) for k, v in C.SCORE.items()])
    both = lanes.join(before.select("lane", F.col("status").alias("before")), "lane", "left").join(after.select("lane", F.col("status").alias("after")), "lane", "left")
    both = both.withColumns({c: F.coalesce(c, F.lit("na")) for c in ("before", "after")})
    return both.withColumn("worse", rank("after") > rank("before"))


def engine_points(before: DataFrame, after: DataFrame) -> DataFrame:
    """Percentage points between the rates of each engine; null only if neither side has one."""
    both = pairs(before, after, ["engine"], "rate")
    points = F.bround(F.bround(F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)), 4) * 100, 1)
    return both.withColumn("points", F.when(F.col("before").isNotNull() | F.col("after").isNotNull(), points))


def count_diff(before: DataFrame, after: DataFrame, by: str, k: int | None = None) -> DataFrame:
    """Counts of both sides, 0 if missing; k: a report's top list, highest later count first, ties by name."""
    both = pairs(before, after, [by], "n").fillna(0, ["before", "after"]).withColumn("change", F.col("after") - F.col("before"))
    return both.orderBy(F.desc("after"), by).limit(k) if k else both


def as_of(dates: DataFrame, snapshots: DataFrame, kind: str = "measure") -> DataFrame:
    """For each date the latest snapshot of the kind on or before it.

    Both are put in one row of time and the last snapshot is carried forward inside a month's range; months are linked
    by their own last snapshot, so no task sees all of time."""
    from pyspark.sql import Window

    s = snapshots.where(F.col("kind") == kind).select(F.col("date"), F.col("file"))
    every = s.select("date", "file", F.lit(0).alias("asks")).unionByName(dates.select("date", F.lit(None).cast("string").alias("file"), F.lit(1).alias("asks")))
    every = every.withColumn("month", F.substring("date", 1, 7)).withColumn("hit", F.when(F.col("asks") == 0, F.struct("date", "file")))
    inside = F.last("hit", ignorenulls=True).over(Window.partitionBy("month").orderBy("date", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = every.groupBy("month").agg(F.max("hit").alias("end"))
    carried = ends.select("month", F.last("end", ignorenulls=True).over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    got = every.withColumn("inside", inside).where("asks = 1").join(carried, "month").withColumn("found", F.coalesce("inside", "carried"))
    return got.select("date", F.col("found.date").alias("snapshot_date"), F.col("found.file").alias("file"))


def metric_verdict(rule, before, after) -> Column:
    """regression, improvement, flat or info by a metric's rule."""
    b, a, r = X.col(before), X.col(after), X.col(rule)
    up, down = a > b, a < b
    return (
        F.when(b.isNull() | a.isNull(), "unknown").when(r == "info", "info").when(r == "up_bad", F.when(up, "regression").when(down, "improvement").otherwise("flat"))
        .when(r == "down_bad", F.when(down, "regression").when(up, "improvement").otherwise("flat")).when(r == "shrink20", F.when(a < b * 0.8, "regression").otherwise("flat")))


def comparable(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: reasons why two measurement summaries must not be compared, empty if they may.  Each side has one
    row (cohorts, fingerprint, errors, unmeasured, incompatible_rows, regression_eligible, cumulative)."""
    b, a = (F.struct("*").alias(n) for n in ("b", "a"))
    both = before.select(b).crossJoin(F.broadcast(after.select(a)))  # one row each
    either = lambda test: test("b") | test("a")
    rules = (
        ("conditions_differ", ~F.col("b.cohorts").eqNullSafe(F.col("a.cohorts"))), ("query_set_differs", ~F.col("b.fingerprint").eqNullSafe(F.col("a.fingerprint"))),
        ("no_cohorts", either(lambda s: F.coalesce(F.size(f"{s}.cohorts"), F.lit(0)) <= 0)), ("errors", either(lambda s: F.col(f"{s}.errors") > 0)),
        ("unmeasured", either(lambda s: F.col(f"{s}.unmeasured") > 0)), ("incompatible_rows", either(lambda s: F.col(f"{s}.incompatible_rows") > 0)),
        ("not_eligible", either(lambda s: ~F.col(f"{s}.regression_eligible"))), ("cumulative", either(lambda s: F.col(f"{s}.cumulative"))))
    return both.select(F.array_compact(F.array(*[F.when(t, n) for n, t in rules])).alias("reasons")).withColumn("comparable", F.size("reasons") == 0)


def next_due(snapshots: DataFrame) -> DataFrame:
    """The last measurement's date, else any last date, plus the wait."""
    last = F.coalesce(F.max(F.when(F.col("kind") == "measure", F.col("date"))), F.max("date"))
    return snapshots.agg(F.date_format(F.date_add(F.to_date(last), C.REMEASURE_DAYS), "yyyy-MM-dd").alias("next_due"))


def stale(baseline, today) -> Column:
    return F.datediff(F.to_date(X.col(today)), F.to_date(X.col(baseline))) > C.STALE_DAYS


def timeline(snapshots: DataFrame) -> DataFrame:
    """One row a date with the file of each kind and the first label that is not empty."""
    files = [F.max(F.when(F.col("kind") == k, F.col("file"))).alias(k) for k in C.SNAPSHOT_KINDS]
    rank = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(C.SNAPSHOT_KINDS)])
    label = F.min_by(X.falsy("label", F.lit(None)), F.when(X.falsy("label", F.lit(None)).isNotNull(), rank))
    return snapshots.groupBy("date").agg(*files, label.alias("label"))


def audit_metrics(pages: DataFrame, findings: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """(metric, value) of an audit: the five that the metric rules judge."""
    from . import rules

    p = pages.agg(F.count("*").alias("pages"), F.count_if((F.col("status") == 200) & rules.noindex()).alias("noindex"), F.count_if((F.col("status") == 200) & (F.col("jsonld_count") > 0)).alias("jsonld_pages"))
    d = findings.agg(F.coalesce(F.max(F.when(F.col("code") == "TITLE_DUPLICATE", F.col("count"))), F.lit(0)).alias("dup_titles"))
    s = sitemaps.agg(F.coalesce(F.sum(F.when(~F.col("is_index"), F.col("url_count"))), F.lit(0)).alias("sitemap_urls"))
    one = p.crossJoin(F.broadcast(d)).crossJoin(F.broadcast(s))  # one row each
    return one.unpivot([], one.columns, "metric", "value")


def metric_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, verdict by the metric's rule."""
    rules = before.sparkSession.createDataFrame(list(C.METRIC_RULES.items()), "metric string, rule string")
    both = pairs(before, after, ["metric"], "value").join(F.broadcast(rules), "metric")
    return both.select("metric", "before", "after", metric_verdict("rule", "before", "after").alias("verdict"))
