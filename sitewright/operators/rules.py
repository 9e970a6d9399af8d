"""The 36 audit rules, the statistics and the lane scorecard.

Page rules are one projection over one scan: each page gets the array of codes that it breaks, which is written once and then
counted with partial sums before the shuffle; the first 20 URLs of a code come from a ranking that keeps 20 rows a task.  Only
the two duplicate rules need a shuffle of titles and descriptions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import robots as R
from ..functions import text as X
from ..functions import urls as U
from ..sources import scratch

URLS = 20
DUPLICATES = {"TITLE_DUPLICATE": "title", "DESC_DUPLICATE": "meta_description"}
ORGANIZATION = ("Organization", "LocalBusiness", "Corporation")

# code -> lane, severity; page rules in order of evaluation, then site rules
PAGE_RULES = {
    "NOINDEX": ("SEO", "critical"), "INTENTIONAL_NOINDEX": ("SEO", "info"), "SNIPPET_RESTRICTED": ("AEO", "warn"),
    "TITLE_DUPLICATE": ("SEO", "warn"), "TITLE_MISSING": ("SEO", "critical"), "TITLE_TOO_LONG": ("SEO", "info"), "TITLE_TOO_SHORT": ("SEO", "warn"),
    "DESC_DUPLICATE": ("SEO", "warn"), "DESC_MISSING": ("SEO", "warn"), "DESC_TOO_LONG": ("SEO", "info"), "DESC_TOO_SHORT": ("SEO", "info"),
    "JSONLD_MISSING": ("AEO", "info"), "FAQ_MISSING": ("AEO", "info"), "ORG_JSONLD_MISSING": ("LLMO", "info"), "ORG_JSONLD_SCATTERED": ("LLMO", "info"),
    "CANONICAL_MISSING": ("SEO", "warn"), "CANONICAL_NOT_SELF": ("SEO", "info"), "H1_MISSING": ("SEO", "warn"), "H1_MULTIPLE": ("SEO", "info"),
    "THIN_TEXT": ("SEO", "warn"), "HTTP_ERROR": ("SEO", "warn"),
}
SITE_RULES = {
    "ROBOTS_MISSING": ("SEO", "warn"), "SITEMAP_NOT_DECLARED": ("SEO", "warn"), "SITEMAP_MISSING": ("SEO", "warn"), "SITEMAP_CRAWL_MISMATCH": ("SEO", "warn"),
    "CRAWL_INCOMPLETE": ("SEO", "critical"), "LLMS_TXT_MISSING": ("GEO", "info"), "SOFT_404": ("SEO", "warn"), "REDIRECT_HOPS": ("SEO", "info"),
    "ALT_HOST_UNREACHABLE": ("SEO", "warn"), "NAVER_VERIFY_MISSING": ("NEO", "warn"), "AI_CRAWLER_BLOCKED": ("GEO", "critical"), "AI_CRAWLER_PARTIAL": ("GEO", "warn"),
    "AI_TRAINING_BLOCKED": ("GEO", "info"), "AI_CRAWLER_UNDECLARED": ("GEO", "info"), "NAVER_CRAWLER_BLOCKED": ("NEO", "critical"),
}
ORDER = {code: i for i, code in enumerate([*PAGE_RULES, *SITE_RULES])}


def missing(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def noindex(ua: str = "googlebot") -> Column:
    return F.array_contains(R.directives("meta_robots", "meta_googlebot", "x_robots_tag", ua), "noindex")


def duplicated(pages: DataFrame, c: str) -> DataFrame:
    """Values that several pages share, with their counts."""
    return pages.where(~missing(c)).groupBy(c).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_summary(pages: DataFrame, c: str) -> DataFrame:
    """One row: groups, pages, ratio of pages that share a value."""
    shared = duplicated(pages, c).agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("pages"))
    total = pages.agg(F.greatest(F.lit(1), F.count("*")).alias("total"))
    return shared.crossJoin(F.broadcast(total)).select("groups", "pages", X.ratio("pages", "total", 3).alias("ratio"))  # one row each


def broken_rules(pages: DataFrame) -> DataFrame:
    """url, pos, the codes that a page breaks by itself (all pages: HTTP_ERROR; pages with status 200: the others), and its title
    and meta_description where they take part in the duplicate rules, else null.  One projection."""
    ok = F.coalesce(F.col("status") == 200, F.lit(False))
    rows = pages.withColumn("_directives", R.directives("meta_robots", "meta_googlebot", "x_robots_tag")).withColumn("_ok", ok)
    has = lambda x: F.array_contains("_directives", x)
    n_title, n_desc = F.char_length("title"), F.char_length("meta_description")
    absolute = F.when(F.col("canonical").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("canonical")).when(
        F.col("canonical").startswith("//"), F.concat(U.scheme_of("url"), F.lit(":"), F.col("canonical"))).when(
        F.col("canonical").startswith("/"), F.concat(U.scheme_of("url"), F.lit("://"), U.host_of("url"), F.col("canonical"))).when(
        F.col("canonical").rlike(r"^[?#]"), F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), F.col("canonical"))).otherwise(
        F.concat(F.regexp_extract("url", r"^([^?#]*/)", 1), F.col("canonical")))
    bare = lambda c: F.regexp_replace(c, r"/+\z", "")
    intended = F.coalesce("intended_indexable", F.lit(True))
    tests = {
        "NOINDEX": has("noindex") & intended, "INTENTIONAL_NOINDEX": has("noindex") & ~intended, "SNIPPET_RESTRICTED": has("nosnippet") | has("max-snippet:0"),
        "TITLE_MISSING": missing("title"),
        "TITLE_TOO_LONG": n_title > X.band_edge("title", C.TITLE_BAND, 1), "TITLE_TOO_SHORT": ~missing("title") & (n_title < X.band_edge("title", C.TITLE_BAND, 0) * 0.4),
        "DESC_MISSING": missing("meta_description"),
        "DESC_TOO_LONG": n_desc > X.band_edge("meta_description", C.DESCRIPTION_BAND, 1), "DESC_TOO_SHORT": ~missing("meta_description") & (n_desc < X.band_edge("meta_description", C.DESCRIPTION_BAND, 0) * 0.5),
        "JSONLD_MISSING": F.coalesce("jsonld_count", F.lit(0)) == 0, "_FAQ": F.arrays_overlap("jsonld_types", F.array(F.lit("FAQPage"), F.lit("QAPage"))),
        "_ORG": F.arrays_overlap("jsonld_types", F.array(*map(F.lit, ORGANIZATION))), "CANONICAL_MISSING": missing("canonical"),
        "CANONICAL_NOT_SELF": ~missing("canonical") & (bare(U.normalize(absolute)) != bare(F.col("url"))),
        "H1_MISSING": F.coalesce(F.size("h1"), F.lit(0)) <= 0, "H1_MULTIPLE": F.size("h1") > 1, "THIN_TEXT": F.coalesce("text_chars", F.lit(0)) < 300,
        "_NAVER": F.col("naver_site_verification"), "_NOINDEX_ANY": has("noindex"), "_OK": F.lit(True),
    }
    error = F.coalesce(F.col("status") >= 400, F.lit(True))
    codes = F.array_compact(F.array(F.when(error, "HTTP_ERROR"), *[F.when(F.col("_ok") & F.coalesce(t, F.lit(False)), F.lit(c)) for c, t in tests.items()]))
    return rows.select("url", "pos", codes.alias("codes"), *[F.when(F.col("_ok") & ~missing(c), F.col(c)).alias(c) for c in DUPLICATES.values()])


def page_findings(pages: DataFrame) -> DataFrame:
    """lane, severity, code, count, urls, ratio of the page rules.  pages needs `pos`, the order in which pages were found.

    pages is scanned once: what each page breaks is written to the shared folder, and the counts, the first URLs and the two
    duplicate rules read only their columns of that.  Counts and lists are then one row, from which every finding is picked."""
    marked = scratch.table(broken_rules(pages), "page-rules")
    hits = marked.select(F.explode("codes").alias("code"), "pos", "url")
    pairs = F.array(*[F.struct(F.lit(code).alias("code"), F.col(c).alias("value")) for code, c in DUPLICATES.items()])
    values = marked.select("pos", "url", F.inline(pairs)).where("value is not null")
    shared = values.groupBy("code", "value").agg(F.count("*").alias("n")).where("n > 1")
    counted = hits.groupBy("code").agg(F.count("*").alias("n")).unionByName(shared.groupBy("code").agg(F.sum("n").alias("n")))
    found = hits.unionByName(values.join(shared, ["code", "value"], "left_semi").select("code", "pos", "url"))
    top = found.withColumn("_rn", F.row_number().over(Window.partitionBy("code").orderBy("pos", "url"))).where(F.col("_rn") <= URLS)
    lists = top.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "url"))), lambda x: x["url"]).alias("urls"))
    keyed = lambda df, c: df.agg(F.map_from_entries(F.collect_list(F.struct("code", c))).alias(c))
    row = keyed(counted, "n").crossJoin(F.broadcast(keyed(lists, "urls")))  # one row each, at most one entry a code

    n = lambda code: F.coalesce(F.element_at("n", code), F.lit(0).cast("long"))
    none = F.expr("cast(array() as array<string>)")
    listed = lambda code: F.coalesce(F.element_at("urls", code), none)
    total = F.greatest(n("_OK"), F.lit(1).cast("long"))
    absent = {"FAQ_MISSING": "_FAQ", "ORG_JSONLD_MISSING": "_ORG", "NAVER_VERIFY_MISSING": "_NAVER"}  # holds if no page has it
    findings = []
    for code, (lane, severity) in (PAGE_RULES | {"NAVER_VERIFY_MISSING": SITE_RULES["NAVER_VERIFY_MISSING"]}).items():
        basis = "_ORG" if code == "ORG_JSONLD_SCATTERED" else code
        test = n(absent[code]) == 0 if code in absent else n(basis) > (1 if basis == "_ORG" else 0)
        count, urls = (F.lit(0).cast("long"), none) if code in absent else (n(basis), listed(basis))
        level = F.when(count > total * 0.5, "critical").otherwise(severity) if code == "THIN_TEXT" else F.lit(severity)
        fields = {"lane": F.lit(lane), "severity": level, "code": F.lit(code), "count": count, "urls": urls, "total": total}
        findings.append(F.when(test, F.struct(*[v.alias(k) for k, v in fields.items()])))
    picked = row.select(F.inline(F.array_compact(F.array(*findings))))
    return picked.select("lane", "severity", "code", "count", "urls", X.ratio("count", "total", 3).alias("ratio"))


SITE = """base string, robots_status int, robots_present boolean, sitemap_declared array<string>, sitemaps array<struct<url:string,status:int,parsed:boolean>>,
only_in_sitemap array<string>, only_in_crawl array<string>, complete boolean, reasons array<string>, llms_status int, probe_404 int, redirect_hops int,
alt_host string, alt_result string, policies map<string,string>"""


def site_findings(site: DataFrame) -> DataFrame:
    """Findings of the site probe (one row of SITE per site)."""
    base = lambda path: F.array(F.concat("base", F.lit(path)))
    none = F.expr("cast(array() as array<string>)")
    live = F.exists("sitemaps", lambda s: (s["status"] == 200) & F.coalesce(s["parsed"], F.lit(True)))
    ends = lambda uas, end: F.filter(F.array(*map(F.lit, uas)), lambda u: F.coalesce(F.element_at("policies", u), F.lit("none")).endswith(end))
    answer, training = (*C.CRAWLERS["search"], *C.CRAWLERS["fetch"]), C.CRAWLERS["training"]
    undeclared = F.filter(F.array(*map(F.lit, (*training, *answer))), lambda u: F.element_at("policies", u) == "none")
    tests = {
        "ROBOTS_MISSING": (~F.col("robots_present"), base("/robots.txt")), "SITEMAP_NOT_DECLARED": (F.col("robots_present") & (F.size("sitemap_declared") == 0), base("/robots.txt")),
        "SITEMAP_MISSING": (~live, F.transform("sitemaps", lambda s: s["url"])),
        "SITEMAP_CRAWL_MISMATCH": (live & (F.size("only_in_sitemap") + F.size("only_in_crawl") > 0), F.when(F.size("only_in_crawl") > 0, F.col("only_in_crawl")).otherwise(F.col("only_in_sitemap"))),
        "CRAWL_INCOMPLETE": (~F.coalesce("complete", F.lit(True)), none), "LLMS_TXT_MISSING": (F.coalesce(F.col("llms_status") != 200, F.lit(True)), base("/llms.txt")),
        "SOFT_404": (F.coalesce(F.col("probe_404") != 404, F.lit(True)), none), "REDIRECT_HOPS": (F.col("redirect_hops") > 1, none),
        "ALT_HOST_UNREACHABLE": (F.col("alt_result").isin("tls_fail", "dns_fail", "error"), F.array(F.concat(F.lit("https://"), "alt_host", F.lit("/")))),
        "AI_CRAWLER_BLOCKED": (F.size(ends(answer, "block")) > 0, ends(answer, "block")), "AI_CRAWLER_PARTIAL": (F.size(ends(answer, "partial")) > 0, ends(answer, "partial")),
        "AI_TRAINING_BLOCKED": (F.size(ends(training, "block")) > 0, ends(training, "block")), "AI_CRAWLER_UNDECLARED": (F.size(undeclared) > 0, undeclared),
        "NAVER_CRAWLER_BLOCKED": (F.size(ends(C.CRAWLERS["korean"], "block")) > 0, ends(C.CRAWLERS["korean"], "block")),
    }
    agents = {"AI_CRAWLER_BLOCKED", "AI_CRAWLER_PARTIAL", "AI_TRAINING_BLOCKED", "AI_CRAWLER_UNDECLARED", "NAVER_CRAWLER_BLOCKED"}
    rows = []
    for code, (test, items) in tests.items():
        lane, severity = SITE_RULES[code]
        urls = none if code in agents else F.slice(items, 1, URLS)
        rows.append(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(lane).alias("lane"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.size(items).cast("long").alias("count"), urls.alias("urls"), (items if code in agents else none).alias("agents"))))
    return site.select("base", F.explode(F.array_compact(F.array(*rows))).alias("f")).select("base", "f.*")


def stats(pages: DataFrame) -> DataFrame:
    ok = F.col("status") == 200
    return pages.agg(
        F.count("*").alias("pages_crawled"), F.count_distinct(F.when(ok, F.nullif("title", F.lit("")))).alias("unique_titles"),
        F.count_distinct(F.when(ok, F.nullif("meta_description", F.lit("")))).alias("unique_descriptions"),
        F.count_if(ok & (F.col("jsonld_count") > 0)).alias("pages_with_jsonld"), F.count_if(ok & noindex()).alias("pages_noindex"))


def lanes(spark) -> DataFrame:
    return spark.createDataFrame([(lane, i) for i, lane in enumerate(C.LANES)], "lane string, ord int")


def scorecard(findings: DataFrame) -> DataFrame:
    """Each lane's status by its worst finding, with its codes in order of evaluation; reputation is never measured."""
    worst = F.min(F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in C.SEVERITY.items()]))
    place = F.create_map(*[F.lit(x) for c, i in ORDER.items() for x in (c, i)])[F.col("code")]
    own = findings.groupBy("lane").agg(worst.alias("w"), F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), "code"))), lambda x: x["code"]).alias("evidence"))
    status = F.when(F.col("lane") == "reputation", "na").when(F.col("w") == 0, "bad").when(F.col("w") == 1, "warn").otherwise("ok")
    board = lanes(findings.sparkSession).join(own, "lane", "left")
    return board.select("ord", "lane", status.alias("status"), F.coalesce(F.when(F.col("lane") != "reputation", F.col("evidence")), F.expr("cast(array() as array<string>)")).alias("evidence"))


def roadmap(findings: DataFrame) -> DataFrame:
    """Findings in the order of work: first of each code, by severity, then by the fixed order; unlisted ones last."""
    steps = findings.sparkSession.createDataFrame(list(C.ROADMAP), "code string, step int, server boolean")
    rank = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in C.SEVERITY.items()])
    first = findings.groupBy("code").agg(F.min_by(F.struct("lane", "severity", "count"), rank).alias("f")).select("code", "f.*")
    joined = first.join(F.broadcast(steps), "code", "left").withColumns({"rank": rank, "step": F.coalesce("step", F.lit(99)), "server": F.coalesce("server", F.lit(False))})
    return joined.withColumn("ord", F.row_number().over(Window.orderBy("rank", "step", "code")))  # at most one row a code


def type_histogram(pages: DataFrame, k: int | None = None) -> DataFrame:
    found = pages.where("status = 200").select(F.explode(F.array_distinct("jsonld_types")).alias("type")).groupBy("type").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "type").limit(k) if k else found


def coverage(c: DataFrame) -> DataFrame:
    """Adds reasons and complete to one row of crawl counters."""
    tests = (
        ("max_pages_reached", F.col("queued_remaining") > 0), ("discovery_queue_truncated", F.col("queue_truncated")), ("seed_blocked_by_robots", F.col("blocked_seeds") > 0),
        ("network_errors", F.col("network_errors") > 0), ("http_errors", F.col("http_errors") > 0), ("no_pages_fetched", F.col("pages_fetched") == 0),
        ("robots_unavailable", F.col("robots_unavailable")), ("sitemap_invalid", F.col("sitemap_invalid") > 0), ("sitemap_truncated", F.col("sitemap_truncated") > 0))
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), n) for n, t in tests]))
    return c.withColumn("reasons", reasons).withColumn("complete", F.size("reasons") == 0)


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in C.SEVERITY])
