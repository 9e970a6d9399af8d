"""Repeated observations: last-wins log, cohorts, rates, top-k, trend, comparison.

Errors and unmeasured attempts never enter a denominator; what is not measured is null, not 0.  Small dimensions are
joined without hints: their size is known to the planner, which broadcasts them only below its threshold."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import text as X
from ..functions import urls as U


def row_key() -> list[Column]:
    """Ten values that tell one planned observation from another; the model is not among them."""
    return [
        F.col("date"), F.col("query_id"), F.col("engine"), F.col("run_no"), X.falsy("mode", "manual"), X.falsy("surface", F.col("engine")),
        X.falsy("locale", ""), X.falsy("login_state", F.when(F.col("signed_out"), "signed_out").otherwise("")),
        F.coalesce(F.col("search_enabled").cast("string"), F.lit("")), X.falsy("campaign_id", "")]


COHORT = ("engine", "mode", "surface", "locale", "login_state", "search_enabled", "model", "campaign_id")


def with_cohort(log: DataFrame) -> DataFrame:
    """The eight condition fields with their defaults in place."""
    return log.withColumns({
        "mode": X.falsy("mode", "manual"), "surface": X.falsy("surface", F.col("engine")), "locale": X.falsy("locale", ""),
        "login_state": X.falsy("login_state", F.when(F.col("signed_out"), "signed_out").otherwise("unknown")),
        "model": X.falsy("model", ""), "campaign_id": X.falsy("campaign_id", "")})


def with_defaults(rows: DataFrame) -> DataFrame:
    """Derived fields of a new row: outcome, surface, and cited only where observed."""
    outcome = F.coalesce("outcome", F.when(F.col("cited").isNotNull(), "observed").when(X.falsy("error", F.lit(None)).isNotNull(), "error").otherwise("unmeasured"))
    rows = rows.withColumn("outcome", outcome).withColumn("mode", X.falsy("mode", "manual"))
    surface = X.falsy("surface", F.when(F.col("mode") == "api", "api").otherwise(F.col("engine")))
    return rows.withColumns({"surface": surface, "cited": F.when(F.col("outcome") == "observed", F.col("cited"))})


def last_wins(log: DataFrame, *order: str) -> DataFrame:
    """One row for each key, the last in order; ranking stops at one row a key before the shuffle."""
    w = Window.partitionBy(*row_key()).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def known(log: DataFrame, queries: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows of known queries inside the dates, with type and whether the query's text is still the one asked."""
    q = queries.select(F.col("id").alias("query_id"), "type", F.col("fingerprint").alias("_now"))
    rows = log.where((F.lit(since).isNull() | (F.col("date") >= F.lit(since))) & (F.lit(until).isNull() | (F.col("date") <= F.lit(until)))).join(q, "query_id")
    stale = (X.falsy("query_fingerprint", F.lit(None)).isNotNull()) & (F.col("query_fingerprint") != F.col("_now")) & ~F.col("schema").endswith("/1")
    return rows.withColumn("compatible", ~F.coalesce(stale, F.lit(False))).drop("_now")


def latest(log: DataFrame, cumulative: bool = False) -> DataFrame:
    """Rows of the last date unless all are asked for."""
    return log if cumulative else log.join(log.agg(F.max("date").alias("date")), "date", "left_semi")


def observed() -> Column:
    return F.col("outcome") == "observed"


def counts(only: Column | None = None) -> list[Column]:
    """Attempts and their outcomes; only: of the rows for which it holds."""
    kept = F.lit(True) if only is None else only
    return [
        F.count_if(kept).alias("attempts"), F.count_if(kept & observed()).alias("runs"), F.count_if(kept & observed() & F.col("cited")).alias("cited"),
        F.count_if(kept & observed() & F.col("brand_mentioned")).alias("mentioned"), F.count_if(kept & (F.col("outcome") == "error")).alias("errors"),
        F.count_if(kept & (F.col("outcome") == "unmeasured")).alias("unmeasured")]


def slots(log: DataFrame) -> DataFrame:
    """Counts for each engine that occurs and both query types, also where a type was not asked; one sum an engine."""
    by = log.groupBy("engine").agg(*[F.struct(F.lit(t).alias("type"), *counts(F.col("type") == t)).alias(t) for t in C.QUERY_TYPES])
    got = by.select("engine", F.inline(F.array(*C.QUERY_TYPES)))
    return got.withColumn("rate", X.ratio("cited", "runs")).withColumn("mention_rate", X.ratio("mentioned", "runs"))


def scopes(log: DataFrame) -> DataFrame:
    """scope (latest, cumulative), runs, cited, rate: of the last date and of all, from one sum a date; no row for an empty log."""
    by = log.groupBy("date").agg(*counts())
    one = by.agg(F.max_by(F.struct("runs", "cited"), "date").alias("latest"), F.struct(F.sum("runs").alias("runs"), F.sum("cited").alias("cited")).alias("cumulative"))
    both = one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("scope"), F.col(s)["runs"].alias("runs"), F.col(s)["cited"].alias("cited")) for s in ("latest", "cumulative")])))
    return both.where("runs is not null").withColumn("rate", X.ratio("cited", "runs"))


def any_cited(log: DataFrame) -> DataFrame:
    """For each engine and type: queries measured, and those cited in any run."""
    by = log.where(observed()).groupBy("engine", "type", "query_id").agg(F.bool_or(F.coalesce("cited", F.lit(False))).alias("any"))
    return by.groupBy("engine", "type").agg(F.count("*").alias("queries"), F.count_if("any").alias("queries_cited")).withColumn("query_rate", X.ratio("queries_cited", "queries"))


def by_query(log: DataFrame, queries: DataFrame) -> DataFrame:
    """Every query with its runs and citations, and one entry an engine, also if it was never run."""
    by = log.where(observed()).groupBy("query_id", "engine").agg(F.count("*").alias("runs"), F.count_if("cited").alias("cited"))
    one = by.groupBy("query_id").agg(F.sum("runs").alias("runs"), F.sum("cited").alias("cited"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("engine", F.struct("runs", "cited"))))).alias("engines"))
    return queries.select(F.col("id").alias("query_id"), "type").join(one, "query_id", "left").fillna(0, ["runs", "cited"])


def url_counts(log: DataFrame) -> DataFrame:
    return log.where(observed()).select("query_id", F.explode("cited_urls").alias("url")).groupBy("query_id", "url").agg(F.count("*").alias("n"))


def top_urls(log: DataFrame, k: int = 10) -> DataFrame:
    """The k most cited URLs of each query; ties by URL."""
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "url")
    return url_counts(log).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def our_urls(log: DataFrame, host: str) -> DataFrame:
    urls = log.where(observed()).select(F.explode("cited_urls").alias("url")).groupBy("url").agg(F.count("*").alias("n"))
    return urls.where(U.is_ours("url", F.lit(host)))


def competitors(log: DataFrame, host: str, k: int | None = 20) -> DataFrame:
    """Domains named beside ours; the k most frequent (a report's top list), ties by name."""
    named = log.where(observed()).select(F.explode("competitor_domains").alias("domain")).where(U.bare_domain("domain") != U.bare_domain(F.lit(host)))
    found = named.groupBy("domain").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "domain").limit(k) if k else found


def cohorts(log: DataFrame) -> DataFrame:
    """Counts for each set of conditions, by type; null-safe on whether search was on."""
    per_type = lambda t, c, n: F.count_if((F.col("type") == t) & c).alias(f"{t}_{n}")
    aggs = [x for t in C.QUERY_TYPES for x in (per_type(t, F.lit(True), "attempts"), per_type(t, observed(), "runs"), per_type(t, observed() & F.col("cited"), "cited"))]
    got = with_cohort(log).groupBy(*COHORT).agg(*aggs, F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "error").alias("errors"))
    got = got.withColumn("error_rate", X.ratio("errors", "attempts"))
    return got.withColumns({f"{t}_rate": X.ratio(f"{t}_cited", f"{t}_runs") for t in C.QUERY_TYPES})


def cohort_queries(log: DataFrame) -> DataFrame:
    """Inside each set of conditions, attempts and outcomes of each query."""
    return with_cohort(log).groupBy(*COHORT, "query_id").agg(*counts())


def trend(log: DataFrame) -> DataFrame:
    """Per date: attempts, runs, citations, queries measured and cited in any run."""
    by = log.groupBy("date", "query_id").agg(*counts())
    return by.groupBy("date").agg(
        *[F.sum(c).alias(c) for c in ("attempts", "runs", "cited", "errors", "unmeasured")], F.count_if(F.col("runs") > 0).alias("queries"),
        F.count_if(F.col("cited") > 0).alias("queries_cited")).withColumn("rate", X.ratio("cited", "runs"))


def trend_engines(log: DataFrame) -> DataFrame:
    by = log.where(observed()).groupBy("date", "engine", "query_id").agg(F.count("*").alias("runs"), F.count_if("cited").alias("cited"))
    return by.groupBy("date", "engine").agg(F.sum("runs").alias("runs"), F.sum("cited").alias("cited"), F.count_if(F.col("cited") > 0).alias("queries_cited"))


def against_baseline(days: DataFrame) -> DataFrame:
    """Each date's rate beside that of the first date.  One row a date: the window's single task holds no more."""
    first = F.first("rate").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return days.select("date", "rate", F.bround(F.bround(F.col("rate") - first, 4) * 100, 1).alias("points"))


def quality(log: DataFrame) -> DataFrame:
    got = log.agg(*counts(), F.count_if(~F.col("compatible")).alias("incompatible_rows"))
    ok = (F.col("errors") == 0) & (F.col("incompatible_rows") == 0)
    return got.select("attempts", F.col("runs").alias("observed"), "errors", "unmeasured", "incompatible_rows", X.ratio("errors", "attempts").alias("error_rate"), ok.alias("regression_eligible"))


def conditions(log: DataFrame) -> DataFrame:
    """Sorted distinct values of each condition; an unknown search setting shows as None."""
    rows = with_cohort(log)
    values = {c: F.col(c) for c in COHORT if c not in ("search_enabled", "engine")}
    values["search_enabled"] = F.coalesce(F.initcap(F.col("search_enabled").cast("string")), F.lit("None"))
    return rows.agg(*[F.array_sort(F.collect_set(v)).alias(n) for n, v in sorted(values.items())])


def plan_rows(queries: DataFrame, engines: DataFrame, runs: int) -> DataFrame:
    """Every query with every engine and run number: the form to fill.  Both tables are lists that a person keeps."""
    return queries.crossJoin(F.broadcast(engines)).withColumn("run_no", F.explode(F.sequence(F.lit(1), F.lit(runs))))


def parse_form(form: DataFrame, queries: DataFrame) -> DataFrame:
    """Form rows with `reason` (the first that applies, null if good) and parsed fields.  cited is empty where nothing was seen."""
    q = queries.select(F.col("id").alias("query_id"), F.col("text").alias("_text"), F.col("type").alias("_type"))
    rows = form.join(q, "query_id", "left").withColumns({
        "_date": X.strict_date("date"), "_run": F.expr("try_cast(trim(run_no) as int)"), "_cited": X.yes_no("cited"), "_search": X.yes_no("search_enabled")})
    blank = lambda c: X.collapse(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = (
        ("bad_date", F.col("_date").isNull()), ("unknown_query", F.col("_text").isNull()),
        ("stale_text", ~blank("query_text") & (X.collapse("query_text") != X.collapse("_text"))), ("stale_type", ~blank("type") & (X.collapse("type") != F.col("_type"))),
        ("bad_engine", ~F.coalesce(F.col("engine").isin(*C.ENGINES), F.lit(False))), ("bad_run_no", F.coalesce(F.col("_run") < 1, F.lit(True))),
        ("bad_cited", ~blank("cited") & F.col("_cited").isNull()), ("bad_login_state", ~blank("login_state") & ~F.col("login_state").isin(*C.LOGIN_STATES)),
        ("bad_search_enabled", ~blank("search_enabled") & F.col("_search").isNull()))
    reason = F.coalesce(*[F.when(F.coalesce(test, F.lit(True)), name) for name, test in rules])
    urls = F.array_distinct(F.filter(F.transform(X.split_multi("cited_urls"), U.clean_url), lambda u: u.isNotNull()))
    return rows.withColumns({"reason": reason, "parsed_urls": urls, "parsed_cited": F.col("_cited"), "parsed_run": F.col("_run")}).drop("_date", "_text", "_type", "_run", "_cited", "_search")


def named_competitors(domains, urls, host: str) -> Column:
    """Domains given by hand and those of cited URLs, once each, without our own."""
    listed = F.transform(X.split_multi(domains), U.bare_domain)
    cited = F.transform(urls, U.bare_domain)
    return F.filter(F.array_distinct(F.concat(listed, cited)), lambda d: (d != "") & ~U.is_ours(d, F.lit(host)))


def significance(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Two tables of (by, cited, runs): interval of each rate, and whether the change can be told from noise."""
    b, a = (t.select(*by, F.col("cited").alias(f"cited_{s}"), F.col("runs").alias(f"runs_{s}")) for t, s in ((before, "before"), (after, "after")))
    both = b.join(a, by, "full_outer").withColumns({f"rate_{s}": X.ratio(f"cited_{s}", f"runs_{s}") for s in ("before", "after")})
    delta = F.bround(F.col("rate_after") - F.col("rate_before"), 4)
    clear = (F.abs(delta) >= C.MIN_DELTA) & (F.least("runs_before", "runs_after") >= C.MIN_RUNS)
    verdict = F.when(delta.isNull(), "not_measured").when(~clear, "inconclusive").when(delta < 0, "regression").otherwise("improvement")
    return both.withColumns({"delta": delta, "verdict": verdict, "interval_before": X.wilson("cited_before", "runs_before"), "interval_after": X.wilson("cited_after", "runs_after")})


def headline(days: DataFrame, n_queries: int, n_engines: int) -> DataFrame:
    """First and last date with rates, points between them, runs per query and engine on the last date, and the next date."""
    edge = lambda pick, c: pick(F.col(c), F.col("date"))
    one = days.agg(F.min("date").alias("baseline"), F.max("date").alias("latest"), edge(F.min_by, "rate").alias("rate_before"), edge(F.max_by, "rate").alias("rate_after"), edge(F.max_by, "runs").alias("runs"))
    per_query = F.greatest(F.lit(1), F.bround(F.try_divide(F.col("runs").cast("double"), F.lit(float(n_queries * n_engines))), 0).cast("int"))
    return one.withColumns({
        "points": F.bround(F.bround(F.col("rate_after") - F.col("rate_before"), 4) * 100, 1), "runs_per_query": per_query,
        "next_date": F.date_format(F.date_add(F.to_date("latest"), C.REMEASURE_DAYS), "yyyy-MM-dd")})


AI_HOSTS = ("chatgpt.com", "perplexity.ai", "gemini.google.com", "claude.ai", "copilot.microsoft.com")


def ai_referrals(sessions: DataFrame) -> DataFrame:
    """Sessions per day that came from an answer engine (date, source)."""
    return sessions.where(U.bare_domain("source").isin(*AI_HOSTS)).groupBy("date").agg(F.count("*").alias("sessions"))


def settled(rows: DataFrame, today: str, lag: int = 3) -> DataFrame:
    """Rows old enough that late reports no longer change them."""
    return rows.where(F.col("date") < F.date_format(F.date_sub(F.to_date(F.lit(today)), lag), "yyyy-MM-dd"))


def totals(engines: DataFrame) -> DataFrame:
    """Sums over engines by type, with rate and interval."""
    got = engines.groupBy("type").agg(*[F.sum(c).alias(c) for c in ("attempts", "runs", "cited", "errors")])
    return got.withColumns({"rate": X.ratio("cited", "runs"), "interval": X.wilson("cited", "runs")})
