"""Audit of a site: crawl with an injected fetch, site probe, findings, scorecard; and its documents.

The crawl goes level by level: a level's URLs are fetched as a table, parsed once, and their links become the next
level after host, asset and robots rules.  Counters of what was left out decide whether the audit is complete."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import robots as R
from ..functions import urls as U
from ..operators import pages as P
from ..operators import rules
from ..sources import html, tables

AGENT = "sitewright"


@dataclass
class Crawl:
    pages: DataFrame
    coverage: DataFrame
    sitemaps: DataFrame
    robots: DataFrame
    locs: DataFrame
    counters: dict = field(default_factory=dict)


def read_sitemaps(spark: SparkSession, candidates: DataFrame, host: str, fetch, most: int = 100, children: int = 100) -> tuple[DataFrame, DataFrame]:
    """files (url, status, is_index, url_count, parsed, error) and locs (url, pos): index files are followed level by level
    on the same host, up to `most` files and `children` of each index; what is left has error inspection_limit."""
    level = P.cut(candidates.select(F.col("url")).where(U.host_of("url") == host).distinct())
    done, locs, left = None, None, most
    while level.limit(1).count() and left > 0:
        n = level.count()
        take = level.orderBy("url").limit(left)
        responses = tables.fetch_all(take, fetch, 0)
        got = P.cut(responses.withColumn("s", html.parse_sitemap("body")).select("url", "status", "error", "s.*"))
        over = level.join(take, "url", "left_anti").select("url", F.lit(None).cast("int").alias("status"), F.lit(False).alias("is_index"), F.lit(0).alias("url_count"), F.lit(False).alias("parsed"), F.lit("inspection_limit").alias("error"))
        ok = got.withColumn("parsed", F.col("parsed") & (F.col("status") == 200))
        rows = ok.select("url", "status", "is_index", F.size("locs").alias("url_count"), "parsed", "error").unionByName(over)
        found = ok.where("parsed and not is_index").select("url", F.posexplode("locs").alias("pos", "loc")).select(F.col("loc").alias("url"), F.col("url").alias("file"), "pos")
        done = P.cut(rows if done is None else done.unionByName(rows))
        locs = P.cut(found if locs is None else locs.unionByName(found))
        nested = ok.where("parsed and is_index").select(F.explode(F.slice("locs", 1, children)).alias("url")).where(U.host_of("url") == host).distinct()
        level, left = P.cut(nested.join(done, "url", "left_anti")), left - min(n, left)
    if done is None:
        done = spark.createDataFrame([], "url string, status int, is_index boolean, url_count int, parsed boolean, error string")
        locs = spark.createDataFrame([], "url string, file string, pos int")
    return done, locs


QUEUE = 4  # URLs that may wait, in parts of max_pages


def crawl(spark: SparkSession, base: str, fetch, max_pages: int = 300, allow_noindex: tuple[str, ...] = ()) -> Crawl:
    """Pages reached from the base and the sitemaps, at most max_pages (the documented limit of a crawl); what is found beyond
    QUEUE times as many waiting URLs counts as cut.  allow_noindex: pages that are meant to stay out of the index."""
    one = spark.createDataFrame([(base,)], "url string").select(U.normalize("url").alias("url"))
    home, host = one.select("url", U.host_of("url").alias("h")).first()
    root = home.split("//", 1)[0] + "//" + host
    robots = P.cut(tables.robots_body(tables.fetch_all(spark.createDataFrame([(f"{root}/robots.txt",)], "url string"), fetch, 0)))
    rule_table = P.cut(R.rules_table(robots.select(F.lit("s").alias("site"), "raw")))
    declared = robots.select(F.explode(R.declared_sitemaps("raw")).alias("url"))
    standard = spark.createDataFrame([(f"{root}/sitemap.xml",), (f"{root}/sitemap_index.xml",)], "url string")
    files, locs = read_sitemaps(spark, declared.unionByName(standard).where(U.scheme_of("url").isin("http", "https")), host, fetch)

    def allowed(urls: DataFrame) -> DataFrame:
        asked = urls.select("url", F.lit("s").alias("site"), F.lit(AGENT).alias("ua"), U.target_of("url").alias("target"))
        verdict = R.allowed(rule_table, asked.select("site", "ua", "target").distinct())
        return asked.join(verdict, ["site", "ua", "target"]).select("url", "allowed")

    eligible = lambda df: df.select(U.normalize("url").alias("url")).where((U.host_of("url") == host) & U.is_page("url") & U.scheme_of("url").isin("http", "https")).distinct()
    seeds = P.cut(allowed(eligible(one.unionByName(locs.select("url")))))
    blocked_seeds = seeds.where("not allowed").count()
    level = P.cut(seeds.where("allowed").select("url", (F.col("url") != home).cast("int").alias("rank")).orderBy("rank", "url").limit(max_pages))
    waiting = seeds.where("allowed").count() - level.count()
    truncated = waiting + level.count() > QUEUE * max_pages
    allowed_out = tuple(r["u"] for r in spark.createDataFrame([(u,) for u in allow_noindex], "u string").select(U.normalize("u").alias("u")).collect())
    pages, seen, depth, fetched = None, level.select("url"), 0, 0
    while level.limit(1).count():
        got = html.page_records(tables.fetch_all(level, fetch, 0), allow_noindex=allowed_out).withColumn("depth", F.lit(depth))
        got = P.cut(got)
        fetched += got.count()
        pages = got if pages is None else pages.unionByName(got)
        same = got.where(U.host_of("final_url") == host).select("final_url", F.explode("links").alias("link")).select(html.resolve("final_url", "link").alias("url"))
        fresh = P.cut(allowed(eligible(same.where("url is not null")).join(seen, "url", "left_anti")).where("allowed").select("url"))
        n, room = fresh.count(), max(0, max_pages - fetched)
        waiting += max(0, n - room)
        truncated |= n + waiting > QUEUE * max_pages
        level = P.cut(fresh.orderBy("url").limit(room))
        seen = P.cut(seen.unionByName(level.select("url")))
        depth += 1
    if pages is None:
        pages = html.page_records(spark.createDataFrame([], C.RESPONSE)).withColumn("depth", F.lit(0))
    pages = P.cut(pages.withColumn("pos", F.col("depth").cast("long")))
    bad = pages.agg(F.count_if(F.col("error").isNotNull()).alias("network"), F.count_if(F.coalesce(F.col("status") >= 400, F.lit(False))).alias("http")).first()
    present = robots.agg(F.count_if((F.coalesce("status", F.lit(0)) >= 500) | F.col("status").isNull()).alias("n")).first()["n"]
    maps = files.agg(F.count_if((F.col("status") == 200) & ~F.col("parsed")).alias("invalid"), F.count_if(F.col("error") == "inspection_limit").alias("cut")).first()
    counters = {"max_pages": max_pages, "pages_fetched": fetched, "queued_remaining": waiting, "queue_truncated": truncated, "blocked_seeds": blocked_seeds, "network_errors": bad["network"], "http_errors": bad["http"], "robots_unavailable": present > 0, "sitemap_invalid": maps["invalid"], "sitemap_truncated": maps["cut"]}
    listed = P.cut(eligible(locs))
    return Crawl(pages, rules.coverage(spark.createDataFrame([tuple(counters.values())], list(counters))), files, robots, listed, counters)


def site_row(spark: SparkSession, base: str, c: Crawl, fetch) -> DataFrame:
    """One row of rules.SITE: probes of llms.txt, a page that cannot exist, the home page and the other host name."""
    host = spark.createDataFrame([(base,)], "u string").select(U.host_of("u").alias("h"), U.alternate_host(U.host_of("u")).alias("alt"), U.normalize("u").alias("n")).first()
    root = host["n"].split("//", 1)[0] + "//" + host["h"]
    probe = lambda url: fetch(url) if url else {}
    llms, missing, home, other = probe(f"{root}/llms.txt"), probe(f"{root}/sitewright-page-that-is-not-there"), probe(f"{root}/"), probe(host["alt"] and f"https://{host['alt']}/")
    result = "na" if not host["alt"] else other.get("error") if other.get("error") in ("tls_fail", "dns_fail") else "error" if other.get("error") else "redirect" if other.get("redirects") else "ok"
    agents = spark.createDataFrame([("s", u) for g in C.CRAWLERS.values() for u in g], "site string, ua string")
    robots = c.robots.select(F.lit("s").alias("site"), "raw", "status", "present")
    policies = R.policies(R.rules_table(robots.select("site", "raw")), agents).agg(F.map_from_entries(F.collect_list(F.struct("ua", "policy"))).alias("policies"))
    locs = c.sitemaps.agg(F.collect_list(F.struct("url", "status", "parsed")).alias("sitemaps"))
    row = robots.select(F.lit(root).alias("base"), F.col("status").alias("robots_status"), F.col("present").alias("robots_present"), R.declared_sitemaps("raw").alias("sitemap_declared"))
    for one in (policies, locs, c.coverage.select("complete", "reasons")):
        row = row.crossJoin(F.broadcast(one))  # one row each
    indexable = c.pages.where((F.col("status") == 200) & ~rules.noindex()).select(U.normalize("url").alias("url"))
    apart = P.set_difference(c.locs, c.pages.select(U.normalize("url").alias("url"))).where("side = 'only_in_sitemap'").unionByName(P.set_difference(c.locs, indexable).where("side = 'only_in_crawl'"))
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("url")))).alias(s)
    row = row.crossJoin(F.broadcast(apart.agg(side("only_in_sitemap"), side("only_in_crawl"))))  # one row: at most the pages of one crawl
    return row.withColumns({"llms_status": F.lit(llms.get("status")).cast("int"), "probe_404": F.lit(missing.get("status")).cast("int"), "redirect_hops": F.lit(home.get("redirects") or 0), "alt_host": F.lit(host["alt"]).cast("string"), "alt_result": F.lit(result)})


def analyze(pages: DataFrame, site: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings, statistics and scorecard."""
    own = rules.page_findings(pages).select("lane", "severity", "code", "count", "urls")
    found = own.unionByName(rules.site_findings(site).select("lane", "severity", "code", "count", "urls"))
    return found, rules.stats(pages), rules.scorecard(found)
