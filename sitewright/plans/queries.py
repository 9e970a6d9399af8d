"""Named queries over the driver's tables, each beside the SQL that gives the same rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import http as H
from ..functions import robots as R
from ..functions import text as X
from ..functions import urls as U
from ..operators import diff as D
from ..operators import measure as M
from ..operators import messages as N
from ..operators import pages as P
from ..operators import rules
from ..operators import verify as V
from ..sources import html, scratch, sinks, snapshots, tables
from ..sources import standins as S
from . import generate as G

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- pages ----------------------------------------------------------------------------------------------------------

PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
NORM = f"""(CASE WHEN regexp_extract(url,'{PARTS}',1)<>'' THEN lower(regexp_extract(url,'{PARTS}',1))||':' ELSE '' END||'//'||lower(regexp_extract(url,'{PARTS}',2))
 ||CASE WHEN regexp_extract(url,'{PARTS}',3)='' THEN '/' ELSE regexp_extract(url,'{PARTS}',3) END||CASE WHEN regexp_extract(url,'{PARTS}',4)<>'' THEN '?'||regexp_extract(url,'{PARTS}',4) ELSE '' END)"""
HOST, PATH = f"lower(regexp_extract(url,'{PARTS}',2))", f"regexp_extract(url,'{PARTS}',3)"
SEGMENT = f"regexp_extract({PATH},'^/([^/]+)',1)"
TITLE = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_extract(html,'(?s)<title>(.*?)</title>',1),'&quot;','"'),'&lt;','<'),'&gt;','>'),'&amp;','&'),'&amp$','&'),'\s+',' ','g'))"""


def _pages(spark, d):
    return S.table(spark, d, "pages")


@query(f"SELECT page_id, lower(regexp_extract(url,'{PARTS}',1)) AS scheme, {HOST} AS host, {PATH} AS path, regexp_extract(url,'{PARTS}',4) AS query, regexp_extract(url,'{PARTS}',5) AS fragment, NOT regexp_matches(lower({PATH}), '\\.({'|'.join(C.ASSET_SUFFIXES)})$') AS is_page FROM pages")
def page_url_parts(spark, d):
    return _pages(spark, d).select("page_id", U.scheme_of("url").alias("scheme"), U.host_of("url").alias("host"), U.part("url", 3).alias("path"), U.part("url", 4).alias("query"), U.part("url", 5).alias("fragment"), U.is_page("url").alias("is_page"))


@query(f"SELECT {NORM} AS url, count(*) AS n FROM pages GROUP BY 1")
def page_normalized_distinct(spark, d):
    return _pages(spark, d).groupBy(U.normalize("url").alias("url")).agg(F.count("*").alias("n"))


@query(f"SELECT {HOST} AS host, count(*) AS n FROM pages GROUP BY 1")
def page_host_counts(spark, d):
    return _pages(spark, d).groupBy(U.host_of("url").alias("host")).agg(F.count("*").alias("n"))


@query(f"SELECT CASE WHEN {SEGMENT}='' THEN '/' ELSE {SEGMENT} END AS section, count(*) AS n FROM pages GROUP BY 1")
def page_section_hist(spark, d):
    return P.section_histogram(_pages(spark, d))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""")
def page_links_exploded(spark, d):
    return _pages(spark, d).select("page_id", F.explode(P.hrefs("html")).alias("href"))


@query("""SELECT page_id, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS links, len(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS distinct_links FROM pages""")
def link_out_degree(spark, d):
    links = P.hrefs("html")
    return _pages(spark, d).select("page_id", F.size(links).cast("long").alias("links"), F.size(F.array_distinct(links)).cast("long").alias("distinct_links"))


@query("""SELECT href, count(*) AS links, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1""")
def link_in_degree(spark, d):
    return page_links_exploded(spark, d).groupBy("href").agg(F.count("*").alias("links"), F.count_distinct("page_id").alias("pages"))


@query("""SELECT regexp_extract(html,'<html lang="([^"]*)"',1) AS lang, count(*) AS n FROM pages GROUP BY 1""")
def page_lang_counts(spark, d):
    return _pages(spark, d).groupBy(F.regexp_extract("html", r'<html lang="([^"]*)"', 1).alias("lang")).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS groups, CAST(coalesce(sum(n),0) AS BIGINT) AS pages, round_even(coalesce(sum(n),0)/(SELECT greatest(1,count(*)) FROM pages)::DOUBLE,3) AS ratio FROM (SELECT {TITLE} t, count(*) n FROM pages GROUP BY 1 HAVING count(*)>1 AND {TITLE}<>'')")
def duplicate_title_finding(spark, d):
    return rules.duplicate_summary(_pages(spark, d).select(P.plain_title("html").alias("title")), "title")


@query(f"SELECT {TITLE} AS title, count(*) AS n FROM pages GROUP BY 1 HAVING count(*)>1 AND {TITLE}<>''")
def duplicate_title_groups(spark, d):
    return rules.duplicated(_pages(spark, d).select(P.plain_title("html").alias("title")), "title")


def _page_table(spark, d):
    """Stand-in page table: status, canonical and robots follow from page_id, so that every rule has something to find."""
    p = _pages(spark, d)
    pid = F.col("page_id")
    title = P.plain_title("html")
    return p.select(
        U.normalize("url").alias("url"), F.when(pid % 17 == 0, 404).otherwise(200).alias("status"), U.normalize("url").alias("final_url"), F.when(pid % 13 != 0, title).alias("title"),
        F.when(pid % 3 == 0, F.substring(title, 1, 30)).alias("meta_description"), F.when(pid % 11 == 0, "noindex, nofollow").alias("meta_robots"), F.lit(None).cast("string").alias("meta_googlebot"),
        F.when(pid % 19 == 0, "otherbot: noindex, max-snippet:0\ngooglebot: nosnippet").alias("x_robots_tag"), F.when(pid % 7 == 0, "/other").when(pid % 2 == 0, U.normalize("url")).alias("canonical"),
        F.array(title).alias("h1"), F.lit(0).alias("jsonld_count"), F.expr("cast(array() as array<string>)").alias("jsonld_types"), F.char_length("html").alias("text_chars"),
        F.lit(False).alias("naver_site_verification"), F.lit(True).alias("intended_indexable"), pid.alias("pos"))


_PT = f"""(SELECT {NORM} AS url, CASE WHEN page_id%17=0 THEN 404 ELSE 200 END AS status, CASE WHEN page_id%13<>0 THEN {TITLE} END AS title, CASE WHEN page_id%3=0 THEN left({TITLE},30) END AS meta_description,
 page_id%11=0 AS noindex, page_id%19=0 AS restricted, CASE WHEN page_id%7=0 THEN '/other' WHEN page_id%2=0 THEN {NORM} END AS canonical, length(html) AS text_chars, page_id AS pos FROM pages)"""


@query(f"""WITH p AS {_PT}, ok AS (SELECT * FROM p WHERE status=200), e AS (
 SELECT 'HTTP_ERROR' AS code, count(*) AS n FROM p WHERE status>=400 UNION ALL SELECT 'NOINDEX', count(*) FROM ok WHERE noindex UNION ALL SELECT 'SNIPPET_RESTRICTED', count(*) FROM ok WHERE restricted
 UNION ALL SELECT 'TITLE_MISSING', count(*) FROM ok WHERE coalesce(title,'')='' UNION ALL SELECT 'TITLE_DUPLICATE', count(*) FROM ok WHERE title IN (SELECT title FROM ok WHERE title<>'' GROUP BY 1 HAVING count(*)>1)
 UNION ALL SELECT 'TITLE_TOO_LONG', count(*) FROM ok WHERE length(title)>60 UNION ALL SELECT 'TITLE_TOO_SHORT', count(*) FROM ok WHERE title<>'' AND length(title)<20
 UNION ALL SELECT 'DESC_MISSING', count(*) FROM ok WHERE coalesce(meta_description,'')='' UNION ALL SELECT 'DESC_DUPLICATE', count(*) FROM ok WHERE meta_description IN (SELECT meta_description FROM ok WHERE meta_description<>'' GROUP BY 1 HAVING count(*)>1)
 UNION ALL SELECT 'DESC_TOO_SHORT', count(*) FROM ok WHERE meta_description<>'' AND length(meta_description)<75
 UNION ALL SELECT 'JSONLD_MISSING', count(*) FROM ok UNION ALL SELECT 'CANONICAL_MISSING', count(*) FROM ok WHERE coalesce(canonical,'')='' UNION ALL SELECT 'CANONICAL_NOT_SELF', count(*) FROM ok WHERE canonical='/other' AND NOT regexp_matches(url,'^[a-z]+://[^/]+/other/*$')
 UNION ALL SELECT 'THIN_TEXT', count(*) FROM ok WHERE text_chars<300)
 SELECT code, CAST(n AS BIGINT) AS n FROM e WHERE n>0 UNION ALL SELECT * FROM (VALUES ('FAQ_MISSING',0),('ORG_JSONLD_MISSING',0),('NAVER_VERIFY_MISSING',0))""")
def finding_counts(spark, d):
    return rules.page_findings(_page_table(spark, d)).select("code", F.col("count").alias("n"))


_TESTS = {
    "NOINDEX": "noindex", "SNIPPET_RESTRICTED": "restricted", "TITLE_MISSING": "coalesce(title,'')=''", "TITLE_DUPLICATE": "title IN (SELECT title FROM ok WHERE title<>'' GROUP BY 1 HAVING count(*)>1)",
    "TITLE_TOO_LONG": "length(title)>60", "TITLE_TOO_SHORT": "title<>'' AND length(title)<20", "DESC_MISSING": "coalesce(meta_description,'')=''",
    "DESC_DUPLICATE": "meta_description IN (SELECT meta_description FROM ok WHERE meta_description<>'' GROUP BY 1 HAVING count(*)>1)", "DESC_TOO_SHORT": "meta_description<>'' AND length(meta_description)<75",
    "JSONLD_MISSING": "true", "CANONICAL_MISSING": "coalesce(canonical,'')=''", "CANONICAL_NOT_SELF": "canonical='/other' AND NOT regexp_matches(url,'^[a-z]+://[^/]+/other/*$')", "THIN_TEXT": "text_chars<300",
}
_LANES_OF = ("('NOINDEX','SEO','critical'),('SNIPPET_RESTRICTED','AEO','warn'),('TITLE_MISSING','SEO','critical'),('TITLE_DUPLICATE','SEO','warn'),('TITLE_TOO_LONG','SEO','info'),('TITLE_TOO_SHORT','SEO','warn'),('DESC_MISSING','SEO','warn'),"
    "('DESC_DUPLICATE','SEO','warn'),('DESC_TOO_SHORT','SEO','info'),('JSONLD_MISSING','AEO','info'),('CANONICAL_MISSING','SEO','warn'),('CANONICAL_NOT_SELF','SEO','info'),('THIN_TEXT','SEO','warn'),('HTTP_ERROR','SEO','warn')")  # fmt: skip
_HITS = " UNION ALL ".join(["SELECT 'HTTP_ERROR' AS code, url, pos FROM p WHERE status>=400", *[f"SELECT '{c}', url, pos FROM ok WHERE {t}" for c, t in _TESTS.items()]])


@query(f"""WITH p AS {_PT}, ok AS (SELECT * FROM p WHERE status=200), h AS ({_HITS}), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY pos, url) AS rn FROM h),
 g AS (SELECT code, count(*) AS count, string_agg(url, ' ' ORDER BY rn) FILTER (rn<=20) AS urls FROM r GROUP BY 1), n AS (SELECT greatest(1, count(*)) AS total FROM ok)
 SELECT lane, CASE WHEN code='THIN_TEXT' AND count>total*0.5 THEN 'critical' ELSE severity END AS severity, code, count, urls, round_even(count/total::DOUBLE,3) AS ratio FROM g JOIN (VALUES {_LANES_OF}) l(code,lane,severity) USING (code), n
 UNION ALL SELECT lane, severity, code, 0, '', 0.0 FROM (VALUES ('AEO','info','FAQ_MISSING'),('LLMO','info','ORG_JSONLD_MISSING'),('NEO','warn','NAVER_VERIFY_MISSING')) t(lane,severity,code)""")
def finding_table(spark, d):
    return rules.page_findings(_page_table(spark, d)).withColumn("urls", F.array_join("urls", " "))


# ---- rules of a site: nations stand in for sites, with facts that follow from their keys ----------------------------------

_ANSWER = [*C.CRAWLERS["search"], *C.CRAWLERS["fetch"]]


def _sites(spark, d):
    n, key = S.table(spark, d, "nation"), F.col("n_nationkey")
    policy = lambda uas, test, value: F.map_from_arrays(F.array(*map(F.lit, uas)), F.array(*[F.when(test, value).otherwise("explicit-allow")] * len(uas)))
    blocked = F.map_concat(policy(_ANSWER, key % 6 == 1, "explicit-block"), policy(C.CRAWLERS["training"], key % 6 == 2, "star-block"), policy(C.CRAWLERS["korean"], key % 6 == 3, "explicit-block"))
    other = F.map_concat(policy(_ANSWER, key % 6 == 4, "star-partial"), policy(C.CRAWLERS["training"], key % 6 == 5, "none"), policy(C.CRAWLERS["korean"], F.lit(False), "none"))
    some = lambda test, c: F.when(test, F.array(c)).otherwise(F.expr("cast(array() as array<string>)"))
    base = F.concat(F.lit("https://"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit(".example"))
    return n.select(
        base.alias("base"), F.when(key % 5 == 0, 404).otherwise(200).alias("robots_status"), (key % 5 != 0).alias("robots_present"), some(key % 4 != 0, F.concat(base, F.lit("/sitemap.xml"))).alias("sitemap_declared"),
        F.array(F.struct(F.concat(base, F.lit("/sitemap.xml")).alias("url"), F.when(key % 7 == 0, 404).otherwise(200).alias("status"), F.lit(True).alias("parsed"))).alias("sitemaps"),
        some(key % 3 == 0, F.concat(base, F.lit("/old"))).alias("only_in_sitemap"), some(key % 3 == 1, F.concat(base, F.lit("/new"))).alias("only_in_crawl"), (key % 8 != 0).alias("complete"),
        F.expr("cast(array() as array<string>)").alias("reasons"), F.when(key % 2 == 0, 404).otherwise(200).alias("llms_status"), F.when(key % 9 == 0, 200).otherwise(404).alias("probe_404"), (key % 4).cast("int").alias("redirect_hops"),
        F.lit("www.other.example").alias("alt_host"), F.when(key % 10 == 0, "dns_fail").when(key % 10 == 1, "tls_fail").otherwise("ok").alias("alt_result"), F.when(key % 6 < 4, blocked).otherwise(other).alias("policies"))


_N_ANSWER, _N_TRAINING, _N_KOREAN = len(_ANSWER), len(C.CRAWLERS["training"]), len(C.CRAWLERS["korean"])
_SITE_TESTS = (
    ("ROBOTS_MISSING", "SEO", "warn", "k%5=0", "1", "base||'/robots.txt'"), ("SITEMAP_NOT_DECLARED", "SEO", "warn", "k%5<>0 AND k%4=0", "1", "base||'/robots.txt'"), ("SITEMAP_MISSING", "SEO", "warn", "k%7=0", "1", "base||'/sitemap.xml'"),
    ("SITEMAP_CRAWL_MISMATCH", "SEO", "warn", "k%7<>0 AND k%3=0", "1", "base||'/old'"), ("SITEMAP_CRAWL_MISMATCH", "SEO", "warn", "k%7<>0 AND k%3=1", "1", "base||'/new'"), ("CRAWL_INCOMPLETE", "SEO", "critical", "k%8=0", "0", "''"),
    ("LLMS_TXT_MISSING", "GEO", "info", "k%2=0", "1", "base||'/llms.txt'"), ("SOFT_404", "SEO", "warn", "k%9=0", "0", "''"), ("REDIRECT_HOPS", "SEO", "info", "k%4>1", "0", "''"), ("ALT_HOST_UNREACHABLE", "SEO", "warn", "k%10<2", "1", "'https://www.other.example/'"),
    ("AI_CRAWLER_BLOCKED", "GEO", "critical", "k%6=1", str(_N_ANSWER), "''"), ("AI_TRAINING_BLOCKED", "GEO", "info", "k%6=2", str(_N_TRAINING), "''"), ("NAVER_CRAWLER_BLOCKED", "NEO", "critical", "k%6=3", str(_N_KOREAN), "''"),
    ("AI_CRAWLER_PARTIAL", "GEO", "warn", "k%6=4", str(_N_ANSWER), "''"), ("AI_CRAWLER_UNDECLARED", "GEO", "info", "k%6=5", str(_N_TRAINING), "''"),
)
_SITE = "s AS (SELECT n_nationkey AS k, 'https://'||lower(replace(n_name,' ','-'))||'.example' AS base FROM nation)"


@query(f"WITH {_SITE} " + " UNION ALL ".join(f"SELECT base, '{lane}' AS lane, '{sev}' AS severity, '{code}' AS code, CAST({n} AS BIGINT) AS count, {url} AS urls FROM s WHERE {test}" for code, lane, sev, test, n, url in _SITE_TESTS))
def site_rule_findings(spark, d):
    return rules.site_findings(_sites(spark, d)).select("base", "lane", "severity", "code", "count", F.array_join("urls", " ").alias("urls"))


# ---- checks of a deployed site ----------------------------------------------------------------------------------------------

_BARE = "(SELECT DISTINCT url FROM p)"


@query(f"""WITH p AS {_PT}, w AS (SELECT DISTINCT url FROM p WHERE pos%22=0), j AS (SELECT p.status=200 AS ok, p.noindex AS now, w.url IS NOT NULL AS was FROM {_BARE} e JOIN p USING (url) LEFT JOIN w ON w.url=e.url),
 c AS (SELECT count(*) FILTER (ok) AS a, count(*) FILTER (NOT ok) AS u, count(*) FILTER (ok AND now AND NOT was) AS n FROM j) SELECT 'noindex' AS id, CASE WHEN n>0 OR a=0 THEN 'fail' WHEN u>0 THEN 'warn' ELSE 'pass' END AS status, CAST(a AS VARCHAR) AS checked, CAST(u AS VARCHAR) AS unverified FROM c""")
def check_noindex(spark, d):
    live = _page_table(spark, d)
    got = V.noindex_check(live.select("url").distinct(), live, live.where("pos % 22 = 0").select("url").distinct())
    return got.select("id", "status", F.col("evidence")["checked"].alias("checked"), F.col("evidence")["unverified"].alias("unverified"))


@query(f"""WITH p AS {_PT}, j AS (SELECT b.status=200 AS ok, a.title AS have, CASE WHEN a.pos%4=0 THEN 'new '||a.title ELSE a.title END AS want, b.title AS live FROM p a JOIN p b USING (url)),
 c AS (SELECT count(*) FILTER (ok) AS k, count(*) FILTER (NOT ok) AS u, count(*) FILTER (ok AND trim(want)<>trim(coalesce(live,''))) AS m FROM j WHERE coalesce(want,'')<>''), g AS (SELECT count(*) AS n FROM (SELECT title FROM p WHERE status=200 AND title<>'' GROUP BY 1 HAVING count(*)>1))
 SELECT 'meta.applied' AS id, CASE WHEN k=0 AND u=0 THEN 'skip' WHEN m>0 THEN 'fail' WHEN u>0 THEN 'warn' ELSE 'pass' END AS status, CAST(m AS VARCHAR) AS n FROM c UNION ALL SELECT 'meta.duplicate', CASE WHEN n>0 THEN 'fail' ELSE 'pass' END, CAST(n AS VARCHAR) FROM g""")
def check_meta(spark, d):
    live = _page_table(spark, d)
    drafts = live.select("url", F.when(F.col("pos") % 4 == 0, F.concat(F.lit("new "), "title")).otherwise(F.col("title")).alias("draft_title"), F.lit(f"{C.TODO}: description>>").alias("draft_description"), F.lit(None).cast("string").alias("draft_canonical"))
    return V.meta_checks(drafts, live).select("id", "status", F.coalesce(F.col("evidence")["misses"], F.col("evidence")["groups"]).alias("n"))


_FIRST20 = "coalesce((SELECT string_agg(v, ' ' ORDER BY v) FROM (SELECT DISTINCT {value} AS v FROM {rows} ORDER BY v LIMIT 20)), '')"
_HOSTED = f"h AS (SELECT {HOST} AS host FROM pages GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _evidence(checks: DataFrame, *keys: str) -> DataFrame:
    """id, status, n (the first of the keys that a check has), sample (its URLs, lines or other names)."""
    e = F.col("evidence")
    sample = F.coalesce(*[e[k] for k in ("urls", "lines", "agents", "needles")], F.lit(""))
    return checks.select("id", "status", F.coalesce(*[e[k] for k in keys]).alias("n"), sample.alias("sample"))


@query(f"""WITH p AS {_PT}, {_HOSTED}, o AS (SELECT DISTINCT url FROM p WHERE {HOST}=(SELECT host FROM h)), j AS (SELECT o.url, status, noindex, canonical FROM o LEFT JOIN (SELECT * FROM p WHERE pos%23<>0) l USING (url)),
 dead AS (SELECT url FROM j WHERE status<>200), barred AS (SELECT url FROM j WHERE status=200 AND noindex), odd AS (SELECT url FROM j WHERE status=200 AND canonical='/other'),
 c AS (SELECT count(*) AS own, count(*) FILTER (status IS NULL) AS u, (SELECT count(*) FROM dead) AS d, (SELECT count(*) FROM barred) AS b, (SELECT count(*) FROM odd) AS o FROM j), f AS (SELECT count(*) AS n FROM p WHERE {HOST}<>(SELECT host FROM h))
 SELECT 'sitemap.reachable' AS id, 'warn' AS status, '1' AS n, '' AS sample UNION ALL SELECT 'sitemap.host', CASE WHEN n>0 THEN 'warn' ELSE 'pass' END, CAST(n AS VARCHAR), '' FROM f
 UNION ALL SELECT 'sitemap.locs', CASE WHEN own=0 THEN 'skip' WHEN d>0 THEN 'fail' WHEN u>0 THEN 'warn' ELSE 'pass' END, CAST(u AS VARCHAR), {_FIRST20.format(value="url", rows="dead")} FROM c
 UNION ALL SELECT 'sitemap.noindex', CASE WHEN own=0 THEN 'skip' WHEN b>0 THEN 'fail' WHEN u>0 THEN 'warn' ELSE 'pass' END, CAST(u AS VARCHAR), {_FIRST20.format(value="url", rows="barred")} FROM c
 UNION ALL SELECT 'sitemap.canonical', CASE WHEN own=0 THEN 'skip' WHEN o>0 THEN 'fail' WHEN u>0 THEN 'warn' ELSE 'pass' END, CAST(u AS VARCHAR), {_FIRST20.format(value="url", rows="odd")} FROM c""")
def check_sitemap(spark, d):
    """A sitemap with every page, checked for the host with most pages; one page in 23 was not looked at."""
    live = _page_table(spark, d)
    host = page_host_counts(spark, d).orderBy(F.desc("n"), "host").first()["host"]
    files = spark.createDataFrame([(3, 3, 1, 100)], "files int, reachable int, remaining int, limit_urls int")
    return _evidence(V.sitemap_checks(live.select("url", "pos"), live.where("pos % 23 <> 0"), host, files), "off", "unverified", "remaining")


_ROBOT_AGENTS = sorted({a for group in C.CRAWLERS.values() for a in group})


@query(f"""WITH lost AS (SELECT 'Disallow: /'||lower(n_name) AS line FROM nation WHERE n_nationkey%5=0), a AS (SELECT unnest([{",".join(f"'{a}'" for a in _ROBOT_AGENTS)}])||'=star-partial' AS agent)
 SELECT 'robots.status' AS id, 'pass' AS status, '200' AS n, '' AS sample UNION ALL SELECT 'robots.preserved', CASE WHEN count(*)>0 THEN 'fail' ELSE 'pass' END, CAST(count(*) AS VARCHAR), {_FIRST20.format(value="line", rows="lost")} FROM lost
 UNION ALL SELECT 'robots.policy', 'fail', '{len(_ROBOT_AGENTS)}', {_FIRST20.format(value="agent", rows="a")} UNION ALL SELECT 'robots.sitemap', 'pass', '1', ''""")
def check_robots(spark, d):
    """Robots rules with one line a nation, of which the deployed file lost one in five; the package bars nothing."""
    lines = lambda rows: rows.agg(F.concat_ws("\n", F.lit("User-agent: *"), F.array_sort(F.collect_list(F.concat(F.lit("Disallow: /"), F.lower("n_name")))), F.lit("Sitemap: https://site.example/sitemap.xml")).alias("raw"))
    nations = S.table(spark, d, "nation")
    live = lines(nations.where("n_nationkey % 5 <> 0")).withColumns({"status": F.lit(200), "present": F.lit(True)})
    package = spark.createDataFrame([("User-agent: *\nAllow: /\n",)], "raw string")
    return _evidence(V.robots_checks(live, lines(nations), package), "lost", "wrong", "declared", "status")


@query("""SELECT 'llms.status' AS id, 'pass' AS status, '200' AS n UNION ALL SELECT 'llms.todo', CASE WHEN count(*)>0 THEN 'fail' ELSE 'pass' END, CAST(count(*) AS VARCHAR) FROM nation WHERE n_nationkey%5=0""")
def check_llms(spark, d):
    """A text with one line a nation, one in five still marked as a draft."""
    line = F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit(f"{C.TODO}: "), "n_name", F.lit(">>"))).otherwise(F.col("n_name"))
    text = S.table(spark, d, "nation").agg(F.array_join(F.collect_list(line), "\n").alias("body"))
    got = V.llms_checks(text.withColumn("status", F.lit(200)), text)
    return got.select("id", "status", F.coalesce(F.col("evidence")["todo"], F.col("evidence")["status"]).alias("n"))


@query(f"""WITH t AS (SELECT page_id AS k, 'https://site.example/'||page_id AS url FROM pages), m AS (SELECT * FROM t WHERE k%13<>0), absent AS (SELECT url FROM m WHERE k%7=0 OR k%9=0), unseen AS (SELECT url||' N'||k AS needle FROM m WHERE k%11=0),
 c AS (SELECT count(*) AS n, count(*) FILTER (k%13=0) AS unmapped, count(*) FILTER (k%9=0) AS broken, count(DISTINCT CASE WHEN k%9<>0 THEN k%3 END) AS orgs, (SELECT count(*) FROM absent) AS a, (SELECT count(*) FROM unseen) AS u FROM t)
 SELECT 'jsonld.present' AS id, CASE WHEN n=0 THEN 'skip' WHEN a>0 THEN 'fail' ELSE 'pass' END AS status, CAST(a AS VARCHAR) AS n, {_FIRST20.format(value="url", rows="absent")} AS sample FROM c
 UNION ALL SELECT 'jsonld.mapping', CASE WHEN n=0 THEN 'skip' WHEN unmapped>0 THEN 'warn' ELSE 'pass' END, CAST(unmapped AS VARCHAR), '' FROM c
 UNION ALL SELECT 'jsonld.type', CASE WHEN n=0 THEN 'skip' WHEN a+broken>0 THEN 'fail' ELSE 'pass' END, CAST(broken AS VARCHAR), '' FROM c
 UNION ALL SELECT 'jsonld.visible', CASE WHEN n=0 THEN 'skip' WHEN u>0 THEN 'fail' WHEN a+broken>0 THEN 'skip' ELSE 'pass' END, CAST(u AS VARCHAR), {_FIRST20.format(value="needle", rows="unseen")} FROM c
 UNION ALL SELECT 'jsonld.org_id', CASE WHEN orgs>1 THEN 'fail' WHEN orgs=0 THEN 'skip' ELSE 'pass' END, CAST(orgs AS VARCHAR), '' FROM c""")
def check_jsonld(spark, d):
    """One organisation a page: some live ones have another name, are broken, do not show it, or have no page in the package."""
    k = F.col("page_id")
    url = F.concat(F.lit("https://site.example/"), k.cast("string"))
    block = lambda letter: F.format_string('{"@type":"Organization","@id":"https://site.example/#o%d","name":"' + letter + '%d"}', k % 3, k)
    p = _pages(spark, d).select("page_id")
    files = p.select(F.concat(F.lit("f"), k.cast("string")).alias("url"), F.array(block("N")).alias("ld"))
    targets = p.select(F.concat(F.lit("f"), k.cast("string")).alias("name"), F.when(k % 13 != 0, url).alias("url"))
    deployed = F.when(k % 9 == 0, "{broken").when(k % 7 == 0, block("M")).otherwise(block("N"))
    live = p.select(url.alias("url"), F.array(deployed).alias("ld"), F.when(k % 11 == 0, "nothing").otherwise(F.format_string("It is N%d.", k)).alias("text"))
    return _evidence(V.jsonld_checks(html.ld_table(files), targets, live, False), "absent", "unmapped", "broken", "unseen", "ids")


@query(f"WITH p AS {_PT}, ok AS (SELECT * FROM p WHERE status=200) SELECT (SELECT count(*) FROM p) AS pages_crawled, count(DISTINCT nullif(title,'')) AS unique_titles, count(DISTINCT nullif(meta_description,'')) AS unique_descriptions, CAST(0 AS BIGINT) AS pages_with_jsonld, count(*) FILTER (noindex) AS pages_noindex FROM ok")
def audit_stats(spark, d):
    return rules.stats(_page_table(spark, d))


_SITEMAP = f"s AS (SELECT DISTINCT {NORM} AS url FROM pages WHERE page_id%3<>0), c AS (SELECT DISTINCT {NORM} AS url FROM pages WHERE page_id%3<2)"


@query(f"WITH {_SITEMAP} SELECT url, 'only_in_sitemap' AS side FROM s WHERE url NOT IN (SELECT url FROM c) UNION ALL SELECT url, 'only_in_crawl' FROM c WHERE url NOT IN (SELECT url FROM s)")
def sitemap_vs_crawl(spark, d):
    p = _pages(spark, d).withColumn("url", U.normalize("url"))
    return P.set_difference(p.where("page_id % 3 <> 0"), p.where("page_id % 3 < 2"))  # every page is on one side at least


@query(f"WITH p AS {_PT}, h AS (SELECT {HOST} AS host FROM pages GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT DISTINCT url FROM p WHERE status=200 AND NOT noindex AND {HOST}=(SELECT host FROM h) AND (canonical IS NULL OR rtrim(canonical,'/')=rtrim(url,'/'))")
def sitemap_eligible(spark, d):
    host = page_host_counts(spark, d).orderBy(F.desc("n"), "host").first()["host"]
    return P.eligible(_page_table(spark, d), host)


@query(f"SELECT url, (row_number() OVER (ORDER BY url)-1)//40 AS chunk FROM (SELECT DISTINCT {NORM} AS url FROM pages)")
def sitemap_chunks(spark, d):
    return P.sitemap_chunks(_pages(spark, d).select(U.normalize("url").alias("url")).distinct(), 40)


_SUFFIX = f"t AS (SELECT page_id, url, {TITLE}||CASE WHEN page_id%5<4 THEN ' | Acme' ELSE '' END AS title FROM pages)"


@query(f"WITH {_SUFFIX}, s AS (SELECT title, CASE WHEN contains(title,'|') THEN '|' WHEN contains(title,'—') THEN '—' WHEN contains(title,'–') THEN '–' WHEN contains(title,'-') THEN '-' WHEN contains(title,'·') THEN '·' WHEN contains(title,':') THEN ':' END AS sep FROM t WHERE title<>''), g AS (SELECT sep, trim(string_split(title,sep)[-1]) AS tail, count(*) AS n FROM s WHERE sep IS NOT NULL GROUP BY 1,2 HAVING tail<>'') SELECT sep, tail, n FROM g WHERE n>=2 AND n>=(SELECT count(*) FROM s)*0.5 ORDER BY n DESC LIMIT 1")
def brand_suffix(spark, d):
    return P.brand_suffix(_pages(spark, d).select(F.concat(P.plain_title("html"), F.when(F.col("page_id") % 5 < 4, " | Acme").otherwise("")).alias("title")))


@query(f"WITH {_SUFFIX}, c AS (SELECT page_id, CASE WHEN title='' THEN NULL WHEN title LIKE '%Acme' AND contains(title,'|') THEN coalesce(nullif(trim(left(title, length(title)-strpos(reverse(title),'|'))),''),title) ELSE title END AS core FROM t), n AS (SELECT core, count(*) k FROM c GROUP BY 1) SELECT page_id, coalesce(c.core,'') AS label, CASE WHEN c.core IS NULL THEN 'none' WHEN k=1 THEN 'title' ELSE 'shared_title' END AS source FROM c LEFT JOIN n ON c.core=n.core")
def page_labels(spark, d):
    p = _pages(spark, d).select(F.col("page_id").cast("string").alias("url"), F.concat(P.plain_title("html"), F.when(F.col("page_id") % 5 < 4, " | Acme").otherwise("")).alias("title"), F.expr("cast(array() as array<string>)").alias("h1"))
    return P.labels(p).select(F.col("url").cast("long").alias("page_id"), "label", "source")


@query(f"SELECT section, pages, url FROM (SELECT {SEGMENT} AS section, count(*) OVER (PARTITION BY {SEGMENT}) AS pages, url, row_number() OVER (PARTITION BY {SEGMENT} ORDER BY length(url), page_id) rn FROM pages) WHERE rn=1 ORDER BY section<>'', section LIMIT 20")
def section_representative(spark, d):
    return P.section_pages(_pages(spark, d).withColumn("pos", F.col("page_id"))).select("section", "pages", "url")


@query(f"SELECT page_id, unnest(range(0, len(list_filter(string_split({PATH},'/'), lambda x: x<>''))+1)) AS depth FROM pages")
def breadcrumb_depths(spark, d):
    p = _pages(spark, d).select("page_id", "url", F.array(P.plain_title("html")).alias("h1"), P.plain_title("html").alias("title"))
    return P.breadcrumbs(p.withColumn("url", F.col("url"))).join(p.select("page_id", "url"), "url").select("page_id", F.col("depth").cast("long").alias("depth"))


# ---- texts ----------------------------------------------------------------------------------------------------------

_SQUEEZED = "regexp_replace(text,'\\s+',' ','g')"


@query(f"SELECT doc_id, CASE WHEN len(regexp_extract_all(t,'[가-힣]'))>=greatest(1.0,length(t)*0.15) THEN 'ko' ELSE 'en' END AS script, CASE WHEN length(t)=0 THEN 'none' WHEN length(t)<50 THEN 'short' WHEN length(t)>60 THEN 'long' ELSE 'ok' END AS verdict FROM (SELECT doc_id, {_SQUEEZED} AS t FROM documents)")
def title_length_verdict(spark, d):
    t = F.regexp_replace("text", r"\s+", " ")
    return S.table(spark, d, "documents").select("doc_id", X.script_of(t).alias("script"), X.length_verdict(t, C.TITLE_BAND).alias("verdict"))


@query("SELECT md5(text) AS text_md5, count(*) AS n FROM documents WHERE text<>'' GROUP BY text HAVING count(*)>1")
def duplicate_text_groups(spark, d):
    return rules.duplicated(S.table(spark, d, "documents").select("text"), "text").select(F.md5("text").alias("text_md5"), "n")


@query("SELECT count(*) AS pages, count(*) FILTER (coalesce(lang,'')='') AS no_lang, count(*) FILTER (coalesce(text,'')='') AS no_text, round_even(count(*) FILTER (length(text)<300)/count(*)::DOUBLE,4) AS thin_ratio FROM documents")
def missing_ratio(spark, d):
    return S.table(spark, d, "documents").agg(F.count("*").alias("pages"), F.count_if(rules.missing("lang")).alias("no_lang"), F.count_if(rules.missing("text")).alias("no_text"), X.ratio(F.count_if(F.char_length("text") < 300), F.count("*")).alias("thin_ratio"))


@query(f"WITH t AS (SELECT doc_id, {_SQUEEZED} AS draft_title FROM documents), n AS (SELECT draft_title, count(*) k FROM t GROUP BY 1) SELECT doc_id, k>1 AS duplicate FROM t JOIN n USING (draft_title)")
def meta_duplicate_flag(spark, d):
    drafts = S.table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("draft_title"))
    return P.draft_duplicates(drafts).select("doc_id", "duplicate")


# ---- observation log ------------------------------------------------------------------------------------------------

_LOG = """raw AS (SELECT event_id, ts, strftime(ts,'%Y-%m-%d') AS date, 'Q'||(user_id%10) AS query_id, CASE WHEN user_id%10<4 THEN 'brand' ELSE 'nonbrand' END AS type,
 ['chatgpt','google_aio','gemini'][user_id%3+1] AS engine, CAST(json_extract_string(props,'$.k') AS INT)%5+1 AS run_no, CASE WHEN user_id%2=0 THEN 'en' ELSE 'ko' END AS locale,
 CASE WHEN user_id%5=0 THEN NULL ELSE user_id%2=0 END AS search_enabled, user_id%10<>9 AS compatible,
 CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'unmeasured' ELSE 'observed' END AS outcome, CASE WHEN event_type IN ('error','signup') THEN NULL ELSE event_type='purchase' END AS cited,
 event_type IN ('purchase','click') AS mentioned, CASE WHEN event_type='purchase' THEN ['https://www.s'||(event_id%6)||'.example.com/p'||(event_id%4), 'https://t'||(event_id%9)||'.example.org/'] ELSE [] END AS cited_urls,
 CASE WHEN event_type IN ('error','signup') THEN [] ELSE ['c'||(event_id%30)||'.example.net'] END AS competitor_domains FROM events),
 allrows AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY date,query_id,engine,run_no,locale,coalesce(CAST(search_enabled AS VARCHAR),'') ORDER BY ts DESC,event_id DESC) rn FROM raw) WHERE rn=1),
 log AS (SELECT * FROM allrows WHERE compatible)"""
OUR_HOST = "s0.example.com"


def _all_rows(spark, d):
    return M.known(M.last_wins(S.log(spark, d), "ts", "event_id"), S.queries(spark))


def _log(spark, d):
    return _all_rows(spark, d).where("compatible")


@query(f"WITH {_LOG} SELECT event_id, date, query_id, engine, run_no, locale, outcome, cited FROM allrows")
def log_last_wins(spark, d):
    return _all_rows(spark, d).select("event_id", "date", "query_id", "engine", "run_no", "locale", "outcome", "cited")


_C = "count(*) AS attempts, count(*) FILTER (outcome='observed') AS runs, count(*) FILTER (outcome='observed' AND cited) AS cited, count(*) FILTER (outcome='observed' AND mentioned) AS mentioned, count(*) FILTER (outcome='error') AS errors, count(*) FILTER (outcome='unmeasured') AS unmeasured"


@query(f"WITH {_LOG}, g AS (SELECT engine, type, {_C} FROM log GROUP BY 1,2) SELECT engine, type, attempts, runs, cited, mentioned, errors, unmeasured, round_even(cited/nullif(runs,0)::DOUBLE,4) AS rate, round_even(mentioned/nullif(runs,0)::DOUBLE,4) AS mention_rate FROM g")
def engine_type_slots(spark, d):
    return M.slots(_log(spark, d))


@query(f"WITH {_LOG}, q AS (SELECT engine,type,query_id, bool_or(coalesce(cited,false)) AS c FROM log WHERE outcome='observed' GROUP BY ALL) SELECT engine, type, count(*) AS queries, count(*) FILTER (c) AS queries_cited, round_even(count(*) FILTER (c)/count(*)::DOUBLE,4) AS query_rate FROM q GROUP BY 1,2")
def query_any_cited(spark, d):
    return M.any_cited(_log(spark, d))


@query(f"WITH {_LOG} SELECT type, count(*) FILTER (outcome='observed') AS runs, round_even(count(*) FILTER (cited)/nullif(count(*) FILTER (outcome='observed'),0)::DOUBLE,4) AS rate FROM log GROUP BY 1")
def citation_rates(spark, d):
    return _log(spark, d).groupBy("type").agg(*M.counts()).select("type", "runs", X.ratio("cited", "runs").alias("rate"))


@query(f"WITH {_LOG}, q AS (SELECT 'Q'||i AS query_id, CASE WHEN i<4 THEN 'brand' ELSE 'nonbrand' END AS type FROM range(10) t(i)), g AS (SELECT query_id, count(*) AS runs, count(*) FILTER (cited) AS cited, count(DISTINCT engine) AS engines FROM log WHERE outcome='observed' GROUP BY 1) SELECT query_id, type, coalesce(runs,0) AS runs, coalesce(cited,0) AS cited, coalesce(engines,0) AS engines FROM q LEFT JOIN g USING (query_id)")
def by_query_bucket(spark, d):
    got = M.by_query(_log(spark, d), S.queries(spark))
    return got.select("query_id", "type", "runs", "cited", F.greatest(F.lit(0), F.coalesce(F.size("engines"), F.lit(0))).cast("long").alias("engines"))


@query(f"WITH {_LOG}, u AS (SELECT query_id, unnest(cited_urls) AS url FROM log WHERE outcome='observed'), g AS (SELECT query_id, url, count(*) AS n FROM u GROUP BY 1,2) SELECT * FROM (SELECT query_id, url, n, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, url) AS INT) AS rank FROM g) WHERE rank<=10")
def top_urls_per_query(spark, d):
    return M.top_urls(_log(spark, d))


@query(f"WITH {_LOG}, u AS (SELECT unnest(competitor_domains) AS domain FROM log WHERE outcome='observed') SELECT domain, count(*) AS n FROM u WHERE domain<>'{OUR_HOST}' GROUP BY 1 ORDER BY n DESC, domain LIMIT 20")
def competitor_top20(spark, d):
    return M.competitors(_log(spark, d), OUR_HOST)


@query(f"WITH {_LOG}, u AS (SELECT unnest(cited_urls) AS url FROM log WHERE outcome='observed') SELECT url, count(*) AS n FROM u WHERE regexp_extract(url,'//(www\\.)?([^/]*)',2)='{OUR_HOST}' GROUP BY 1")
def ours_vs_competitor(spark, d):
    return M.our_urls(_log(spark, d), OUR_HOST)


_TYPES = ", ".join(f"count(*) FILTER (type='{t}') AS {t}_attempts, count(*) FILTER (type='{t}' AND outcome='observed') AS {t}_runs, count(*) FILTER (type='{t}' AND cited) AS {t}_cited, round_even(count(*) FILTER (type='{t}' AND cited)/nullif(count(*) FILTER (type='{t}' AND outcome='observed'),0)::DOUBLE,4) AS {t}_rate" for t in C.QUERY_TYPES)


@query(f"WITH {_LOG} SELECT engine, 'manual' AS mode, engine AS surface, locale, 'signed_out' AS login_state, search_enabled, '' AS model, '' AS campaign_id, {_TYPES}, count(*) AS attempts, count(*) FILTER (outcome='error') AS errors, round_even(count(*) FILTER (outcome='error')/count(*)::DOUBLE,4) AS error_rate FROM log GROUP BY engine, locale, search_enabled")
def cohort_slots(spark, d):
    return M.cohorts(_log(spark, d))


_TREND = f"WITH {_LOG}, q AS (SELECT date, query_id, {_C} FROM log GROUP BY 1,2), t AS (SELECT date, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(cited) AS BIGINT) AS cited, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(unmeasured) AS BIGINT) AS unmeasured, count(*) FILTER (runs>0) AS queries, count(*) FILTER (cited>0) AS queries_cited, round_even(sum(cited)/nullif(sum(runs),0)::DOUBLE,4) AS rate FROM q GROUP BY 1)"


@query(f"{_TREND} SELECT * FROM t")
def daily_trend(spark, d):
    return M.trend(_log(spark, d))


@query(f"WITH {_LOG}, q AS (SELECT date, engine, query_id, count(*) AS runs, count(*) FILTER (cited) AS cited FROM log WHERE outcome='observed' GROUP BY ALL) SELECT date, engine, CAST(sum(runs) AS BIGINT) AS runs, CAST(sum(cited) AS BIGINT) AS cited, count(*) FILTER (cited>0) AS queries_cited FROM q GROUP BY 1,2")
def daily_trend_engines(spark, d):
    return M.trend_engines(_log(spark, d))


@query(f"{_TREND} SELECT date, rate, round_even(round_even(rate - first_value(rate) OVER (ORDER BY date),4)*100,1) AS points FROM t")
def trend_delta_vs_baseline(spark, d):
    return M.against_baseline(M.trend(_log(spark, d)))


@query(f"WITH {_LOG}, l AS (SELECT *, 'latest' AS scope FROM log WHERE date=(SELECT max(date) FROM log) UNION ALL SELECT *, 'cumulative' FROM log) SELECT scope, count(*) FILTER (outcome='observed') AS runs, count(*) FILTER (cited) AS cited, round_even(count(*) FILTER (cited)/nullif(count(*) FILTER (outcome='observed'),0)::DOUBLE,4) AS rate FROM l GROUP BY 1")
def latest_vs_cumulative(spark, d):
    return M.scopes(_log(spark, d))


@query(f"WITH {_LOG} SELECT count(*) AS attempts, count(*) FILTER (outcome='observed') AS observed, count(*) FILTER (outcome='error') AS errors, count(*) FILTER (outcome='unmeasured') AS unmeasured, count(*) FILTER (NOT compatible) AS incompatible_rows, round_even(count(*) FILTER (outcome='error')/count(*)::DOUBLE,4) AS error_rate, count(*) FILTER (outcome='error')=0 AND count(*) FILTER (NOT compatible)=0 AS regression_eligible FROM allrows")
def quality_block(spark, d):
    return M.quality(_all_rows(spark, d))


@query(f"WITH {_LOG} SELECT string_agg(DISTINCT engine, ',' ORDER BY engine) AS surface, string_agg(DISTINCT locale, ',' ORDER BY locale) AS locale, string_agg(DISTINCT CASE WHEN search_enabled IS NULL THEN 'None' WHEN search_enabled THEN 'True' ELSE 'False' END, ',' ORDER BY CASE WHEN search_enabled IS NULL THEN 'None' WHEN search_enabled THEN 'True' ELSE 'False' END) AS search_enabled FROM log")
def condition_sets(spark, d):
    return M.conditions(_log(spark, d)).select(*[F.array_join(c, ",").alias(c) for c in ("surface", "locale", "search_enabled")])


@query("SELECT id, type, sha256(type||chr(10)||text) AS fingerprint FROM (SELECT 'Q'||i AS id, 'question '||i AS text, CASE WHEN i<4 THEN 'brand' ELSE 'nonbrand' END AS type FROM range(10) t(i))")
def query_fingerprint(spark, d):
    return S.queries(spark).select("id", "type", "fingerprint")


@query("SELECT sha256(string_agg(f, chr(10) ORDER BY f)) AS fingerprint FROM (SELECT sha256(CASE WHEN i<4 THEN 'brand' ELSE 'nonbrand' END||chr(10)||'question '||i) AS f FROM range(10) t(i))")
def queryset_fingerprint(spark, d):
    return S.queries(spark).agg(X.set_fingerprint("fingerprint").alias("fingerprint"))


@query("SELECT 'Q'||i AS id, e AS engine, CAST(r AS INT) AS run_no FROM range(10) t(i), (VALUES ('chatgpt'),('google_aio')) x(e), range(1,6) y(r)")
def planned_form_rows(spark, d):
    engines = spark.createDataFrame([(e,) for e in C.DEFAULT_ENGINES], "engine string")
    return M.plan_rows(S.queries(spark), engines, 5).select("id", "engine", "run_no")


_FORM = """('2026-01-02','Q1','question 1','brand','chatgpt','1','signed_out','y','예'),('2026-1-2','Q5','','','gemini','2','','',''),('2026-13-01','Q1','','','chatgpt','1','','',''),('2026-01-02','Q77','','','chatgpt','1','','',''),
('2026-01-02','Q1','other','','chatgpt','1','','',''),('2026-01-02','Q1','','nonbrand','chatgpt','1','','',''),('2026-01-02','Q1','','','altavista','1','','',''),('2026-01-02','Q1','','','chatgpt','0','','',''),('2026-01-02','Q1','','','chatgpt','x','','',''),
('2026-01-02','Q1','','','chatgpt','1','','','maybe'),('2026-01-02','Q1','','','chatgpt','1','away','',''),('2026-01-02','Q1','','','chatgpt','1','','perhaps','n')"""
_FORM_COLS = "t(date,query_id,query_text,type,engine,run_no,login_state,search_enabled,cited)"


@query(f"""WITH q AS (SELECT 'Q'||i AS id, 'question '||i AS text, CASE WHEN i<4 THEN 'brand' ELSE 'nonbrand' END AS kind FROM range(10) r(i)), f AS (SELECT * FROM (VALUES {_FORM}) AS {_FORM_COLS}) SELECT date, query_id, engine, run_no, cited,
 CASE WHEN try_cast(date AS DATE) IS NULL THEN 'bad_date' WHEN q.id IS NULL THEN 'unknown_query' WHEN query_text<>'' AND query_text<>q.text THEN 'stale_text' WHEN type<>'' AND type<>kind THEN 'stale_type' WHEN engine NOT IN ({','.join(repr(e) for e in C.ENGINES)}) THEN 'bad_engine'
 WHEN coalesce(try_cast(run_no AS INT),0)<1 THEN 'bad_run_no' WHEN cited<>'' AND cited NOT IN ('예','n') THEN 'bad_cited' WHEN login_state<>'' AND login_state NOT IN ({','.join(repr(e) for e in C.LOGIN_STATES)}) THEN 'bad_login_state' WHEN search_enabled<>'' AND search_enabled NOT IN ('y') THEN 'bad_search_enabled' END AS reason FROM f LEFT JOIN q ON f.query_id=q.id""")
def csv_row_validation(spark, d):
    form = spark.sql(f"SELECT *, '' AS cited_urls FROM VALUES {_FORM} AS {_FORM_COLS}")
    return M.parse_form(form, S.queries(spark)).select("date", "query_id", "engine", "run_no", "cited", "reason")


_WILSON = "CASE WHEN n>0 THEN round_even({f}(({p}+1.959963984540054*1.959963984540054/(2*n))/(1+1.959963984540054*1.959963984540054/n) {s} 1.959963984540054*sqrt({p}*(1-{p})/n+1.959963984540054*1.959963984540054/(4*n*n))/(1+1.959963984540054*1.959963984540054/n)),4) END"
_LOW, _HIGH = _WILSON.format(f="greatest(0.0,", p="(s/n)", s="-").replace("(0.0,(", "(0.0,", 1), _WILSON.format(f="least(1.0,", p="(s/n)", s="+").replace("(1.0,(", "(1.0,", 1)


@query(f"WITH {_LOG}, g AS (SELECT engine, type, CAST(count(*) FILTER (cited) AS DOUBLE) AS s, CAST(count(*) FILTER (outcome='observed') AS DOUBLE) AS n FROM log GROUP BY 1,2) SELECT engine, type, {_LOW} AS low, {_HIGH} AS high FROM g")
def wilson_interval(spark, d):
    return M.slots(_log(spark, d)).withColumn("w", X.wilson("cited", "runs")).select("engine", "type", "w.low", "w.high")


_SIDES = "b AS (SELECT engine, count(*) FILTER (cited) AS cited, count(*) FILTER (outcome='observed') AS runs FROM log WHERE date<'2024-01-16' GROUP BY 1), a AS (SELECT engine, count(*) FILTER (cited) AS cited, count(*) FILTER (outcome='observed') AS runs FROM log WHERE date>='2024-01-16' GROUP BY 1)"


def _sides(spark, d, *by):
    rows = _log(spark, d)
    return tuple(t.groupBy(*by).agg(*M.counts()) for t in (rows.where("date < '2024-01-16'"), rows.where("date >= '2024-01-16'")))


@query(f"WITH {_LOG}, {_SIDES}, j AS (SELECT engine, round_even(a.cited/nullif(a.runs,0)::DOUBLE,4) AS rate_after, round_even(b.cited/nullif(b.runs,0)::DOUBLE,4) AS rate_before, least(a.runs,b.runs) AS m FROM a FULL JOIN b USING (engine)) SELECT engine, rate_before, rate_after, round_even(rate_after-rate_before,4) AS delta, CASE WHEN rate_after-rate_before IS NULL THEN 'not_measured' WHEN NOT (abs(round_even(rate_after-rate_before,4))>=0.1 AND m>=5) THEN 'inconclusive' WHEN rate_after<rate_before THEN 'regression' ELSE 'improvement' END AS verdict FROM j")
def rate_significance(spark, d):
    before, after = _sides(spark, d, "engine")
    return M.significance(before, after, ["engine"]).select("engine", "rate_before", "rate_after", "delta", "verdict")


@query(f"WITH {_LOG}, {_SIDES} SELECT engine, round_even(round_even(coalesce(round_even(a.cited/nullif(a.runs,0)::DOUBLE,4),0)-coalesce(round_even(b.cited/nullif(b.runs,0)::DOUBLE,4),0),4)*100,1) AS points FROM a FULL JOIN b USING (engine)")
def engine_points_diff(spark, d):
    before, after = (t.withColumn("rate", X.ratio("cited", "runs")) for t in _sides(spark, d, "engine"))
    return D.engine_points(before, after).select("engine", "points")


_HALF = "SELECT {c} FROM log WHERE outcome='observed' AND date{op}'2024-01-16'"


@query(f"WITH {_LOG}, b AS (SELECT url, count(*) AS n FROM (SELECT unnest(cited_urls) AS url FROM log WHERE outcome='observed' AND date<'2024-01-16') GROUP BY 1), a AS (SELECT url, count(*) AS n FROM (SELECT unnest(cited_urls) AS url FROM log WHERE outcome='observed' AND date>='2024-01-16') GROUP BY 1) SELECT url, coalesce(b.n,0) AS before, coalesce(a.n,0) AS after, coalesce(a.n,0)-coalesce(b.n,0) AS change FROM a FULL JOIN b USING (url)")
def ours_diff(spark, d):
    rows = _log(spark, d)
    side = lambda t: M.url_counts(t).groupBy("url").agg(F.sum("n").alias("n"))
    return D.count_diff(side(rows.where("date < '2024-01-16'")), side(rows.where("date >= '2024-01-16'")), "url")


@query(f"WITH {_LOG}, b AS (SELECT domain, count(*) AS n FROM (SELECT unnest(competitor_domains) AS domain FROM log WHERE date<'2024-01-16') GROUP BY 1), a AS (SELECT domain, count(*) AS n FROM (SELECT unnest(competitor_domains) AS domain FROM log WHERE date>='2024-01-16') GROUP BY 1) SELECT domain, coalesce(b.n,0) AS before, coalesce(a.n,0) AS after, coalesce(a.n,0)-coalesce(b.n,0) AS change FROM a FULL JOIN b USING (domain) ORDER BY after DESC, domain LIMIT 20")
def competitor_diff(spark, d):
    rows = _log(spark, d)
    side = lambda t: M.competitors(t, OUR_HOST, None)
    return D.count_diff(side(rows.where("date < '2024-01-16'")), side(rows.where("date >= '2024-01-16'")), "domain", 20)


# ---- snapshots ------------------------------------------------------------------------------------------------------

_SNAP = "snap AS (SELECT DISTINCT strftime(ts,'%Y-%m-%d') AS date, CASE WHEN day(ts)%7=1 THEN 'audit' WHEN day(ts)%3=0 THEN 'measure' ELSE 'verify' END AS kind FROM events), s AS (SELECT kind, date, kind||'-'||date||'.json' AS file, CASE WHEN kind='measure' THEN 'm '||date ELSE '' END AS label FROM snap)"


def _snapshots(spark, d):
    day = F.dayofmonth("ts")
    kind = F.when(day % 7 == 1, "audit").when(day % 3 == 0, "measure").otherwise("verify")
    s = S.table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date"), kind.alias("kind")).distinct()
    return s.withColumns({"file": F.concat("kind", F.lit("-"), "date", F.lit(".json")), "label": F.when(F.col("kind") == "measure", F.concat(F.lit("m "), "date")).otherwise("")})


@query(f"WITH {_SNAP}, d AS (SELECT DISTINCT date FROM s), m AS (SELECT * FROM s WHERE kind='measure') SELECT d.date, m.date AS snapshot_date, m.file FROM d ASOF LEFT JOIN m ON d.date>=m.date")
def asof_snapshot(spark, d):
    s = _snapshots(spark, d)
    return D.as_of(s.select("date").distinct(), s)


@query(f"WITH {_SNAP} SELECT strftime(CAST(coalesce(max(date) FILTER (kind='measure'), max(date)) AS DATE)+14,'%Y-%m-%d') AS next_due FROM s")
def next_due(spark, d):
    return D.next_due(_snapshots(spark, d))


@query(f"WITH {_SNAP} SELECT kind, min(date) AS baseline, date_diff('day', CAST(min(date) AS DATE), DATE '2024-02-10')>30 AS stale FROM s GROUP BY 1")
def stale_baseline(spark, d):
    return _snapshots(spark, d).groupBy("kind").agg(F.min("date").alias("baseline")).withColumn("stale", D.stale("baseline", F.lit("2024-02-10")))


@query(f"WITH {_SNAP} SELECT date, max(file) FILTER (kind='audit') AS audit, max(file) FILTER (kind='measure') AS measure, max(file) FILTER (kind='verify') AS verify, max(nullif(label,'')) AS label FROM s GROUP BY 1")
def timeline_merge(spark, d):
    return D.timeline(_snapshots(spark, d))


_METRICS = "('noindex','up_bad',1,2),('noindex','up_bad',2,1),('jsonld_pages','down_bad',5,4),('jsonld_pages','down_bad',4,4),('dup_titles','up_bad',3,3),('sitemap_urls','shrink20',100,79),('sitemap_urls','shrink20',100,80),('pages','info',8,9),('pages','info',NULL,9)"


@query(f"SELECT metric, before, after, CASE WHEN before IS NULL OR after IS NULL THEN 'unknown' WHEN rule='info' THEN 'info' WHEN rule='up_bad' THEN CASE WHEN after>before THEN 'regression' WHEN after<before THEN 'improvement' ELSE 'flat' END WHEN rule='down_bad' THEN CASE WHEN after<before THEN 'regression' WHEN after>before THEN 'improvement' ELSE 'flat' END ELSE CASE WHEN after<before*0.8 THEN 'regression' ELSE 'flat' END END AS verdict FROM (VALUES {_METRICS}) AS t(metric,rule,before,after)")
def metric_classification(spark, d):
    t = spark.sql(f"SELECT * FROM VALUES {_METRICS} AS t(metric,rule,before,after)")
    return t.select("metric", "before", "after", D.metric_verdict("rule", "before", "after").alias("verdict"))


def _halves(spark, d):
    """Findings-like counts of two halves of documents: one code a source and script."""
    docs = S.table(spark, d, "documents").select("doc_id", F.concat(F.lit("C_"), "source").alias("code"), F.when(F.col("doc_id") % 5 == 0, "critical").otherwise("warn").alias("severity"))
    return docs.where("(doc_id % 2 = 0 and code <> 'C_src3') or code = 'C_src4'"), docs.where("(doc_id % 2 = 1 and code <> 'C_src4') or code = 'C_src3'")


_FD = "h AS (SELECT doc_id, 'C_'||source AS code, CASE WHEN doc_id%5=0 THEN 'critical' ELSE 'warn' END AS severity FROM documents), b AS (SELECT code, arg_min(severity, doc_id) AS severity_before, count(*) AS urls_before FROM h WHERE (doc_id%2=0 AND code<>'C_src3') OR code='C_src4' GROUP BY 1), a AS (SELECT code, arg_min(severity, doc_id) AS severity_after, count(*) AS urls_after FROM h WHERE (doc_id%2=1 AND code<>'C_src4') OR code='C_src3' GROUP BY 1)"


@query(f"WITH {_FD} SELECT code, severity_before, urls_before, severity_after, urls_after, CASE WHEN severity_after IS NULL THEN 'resolved' WHEN severity_before IS NULL THEN 'new' ELSE 'persisting' END AS state FROM b FULL JOIN a USING (code)")
def finding_diff(spark, d):
    sides = [t.withColumns({"lane": F.lit("SEO"), "urls": F.array(F.col("doc_id").cast("string")), "pos": F.col("doc_id")}) for t in _halves(spark, d)]
    grouped = [t.groupBy("code").agg(F.min_by("severity", "pos").alias("severity"), F.sum(F.size("urls")).alias("urls")) for t in sides]
    return D.finding_diff(*grouped)


@query(f"WITH {_FD} SELECT code AS key, urls_before AS before, urls_after AS after, urls_after-urls_before AS change FROM b FULL JOIN a USING (code)")
def stats_diff(spark, d):
    b, a = (t.groupBy(F.col("code").alias("key")).agg(F.count("*").alias("value")) for t in _halves(spark, d))
    return D.stats_diff(b, a)


@query(f"WITH p AS (SELECT DISTINCT {NORM} AS url, page_id%4<>1 AS b, page_id%4<>0 AS a FROM pages), b AS (SELECT DISTINCT url FROM p WHERE b), a AS (SELECT DISTINCT url FROM p WHERE a) SELECT url, 'gone' AS state FROM b WHERE url NOT IN (SELECT url FROM a) UNION ALL SELECT url, 'new' FROM a WHERE url NOT IN (SELECT url FROM b)")
def page_diff(spark, d):
    p = _pages(spark, d).withColumns({"url": U.normalize("url"), "status": F.lit(200)})
    return D.page_diff(p.where("page_id % 4 <> 1"), p.where("page_id % 4 <> 0"))  # every page is on one side at least


_FDC = f"{_FD}, j AS (SELECT code, severity_before, severity_after, urls_before, urls_after, CASE WHEN severity_after IS NULL THEN 'resolved' WHEN severity_before IS NULL THEN 'new' ELSE 'persisting' END AS state FROM b FULL JOIN a USING (code))"


@query(f"""WITH {_FDC}, c AS (SELECT count(*) FILTER (state='resolved') AS r, count(*) FILTER (state='new') AS n, count(*) FILTER (state='persisting') AS p, count(*) FILTER (state='new' AND severity_after='critical') AS nc,
 count(*) FILTER (state='persisting' AND (severity_after='critical' OR urls_after>urls_before)) AS w FROM j)
 SELECT 'diff.resolved' AS id, 'pass' AS status, CAST(r AS VARCHAR) AS n FROM c UNION ALL SELECT 'diff.new', CASE WHEN nc>0 THEN 'fail' WHEN n>0 THEN 'warn' ELSE 'pass' END, CAST(n AS VARCHAR) FROM c
 UNION ALL SELECT 'diff.persisting', CASE WHEN w>0 THEN 'warn' ELSE 'pass' END, CAST(p AS VARCHAR) FROM c UNION ALL SELECT 'diff.scorecard', 'fail', '1' UNION ALL SELECT 'diff.stats', 'pass', '1'
 UNION ALL SELECT 'diff.pages', CASE WHEN count(*)>0 THEN 'warn' ELSE 'pass' END, CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT {NORM} AS url FROM pages WHERE page_id%4<>1 EXCEPT SELECT DISTINCT {NORM} FROM pages WHERE page_id%4<>0)""")
def check_diff(spark, d):
    """Six checks over two sides: findings from documents, pages by page_id, a lane that got worse and one changed figure."""
    p = _pages(spark, d).withColumns({"url": U.normalize("url"), "status": F.lit(200)})
    sides = []
    for rows, pages, lane, value in zip(_halves(spark, d), (p.where("page_id % 4 <> 1"), p.where("page_id % 4 <> 0")), ("ok", "bad"), (1, 2)):
        found = rows.groupBy("code").agg(F.min_by("severity", "doc_id").alias("severity"), F.count("*").cast("long").alias("count"), F.collect_list(F.col("doc_id").cast("string")).alias("urls")).withColumns({"lane": F.lit("SEO"), "pos": F.lit(0)})
        board = spark.createDataFrame([("SEO", lane)], "lane string, status string")
        sides.append({"findings": found, "pages": pages, "scorecard": board, "stats": spark.createDataFrame([("pages", value), ("same", 1)], "key string, value long")})
    e = F.col("evidence")
    return V.diff_checks(*sides).select("id", "status", F.coalesce(e["n"], e["worse"], e["changed"], e["gone"]).alias("n"))


_FINDINGS = "('SEO','warn','TITLE_DUPLICATE'),('SEO','critical','NOINDEX'),('AEO','info','FAQ_MISSING'),('GEO','warn','AI_CRAWLER_PARTIAL'),('NEO','warn','NAVER_VERIFY_MISSING')"


@query(f"WITH f AS (SELECT * FROM (VALUES {_FINDINGS}) t(lane,severity,code)), l AS (SELECT * FROM (VALUES ('SEO'),('AEO'),('GEO'),('LLMO'),('NEO'),('reputation')) t(lane)) SELECT lane, CASE WHEN lane='reputation' THEN 'na' WHEN bool_or(severity='critical') THEN 'bad' WHEN bool_or(severity='warn') THEN 'warn' ELSE 'ok' END AS status, coalesce(string_agg(code, ',' ORDER BY code),'') AS evidence FROM l LEFT JOIN f USING (lane) GROUP BY lane")
def scorecard_from_findings(spark, d):
    f = spark.sql(f"SELECT * FROM VALUES {_FINDINGS} AS t(lane,severity,code)")
    return rules.scorecard(f).select("lane", "status", F.array_join(F.array_sort("evidence"), ",").alias("evidence"))


_LANES = "('SEO','ok','bad'),('AEO','warn','ok'),('GEO','ok','ok'),('NEO',NULL,'warn')"


@query(f"WITH t AS (SELECT * FROM (VALUES {_LANES}) x(lane,b,a)), l AS (SELECT * FROM (VALUES ('SEO'),('AEO'),('GEO'),('LLMO'),('NEO'),('reputation')) y(lane)), j AS (SELECT lane, coalesce(b,'na') AS before, coalesce(a,'na') AS after FROM l LEFT JOIN t USING (lane)) SELECT lane, before, after, list_position(['na','ok','warn','bad'],after)>list_position(['na','ok','warn','bad'],before) AS worse FROM j")
def lane_diff(spark, d):
    t = spark.sql(f"SELECT * FROM VALUES {_LANES} AS t(lane,b,a)")
    sides = [t.where(f"{c} is not null").select("lane", F.col(c).alias("status")) for c in ("b", "a")]
    return D.lane_diff(rules.lanes(spark).select("lane"), *sides)


_STEPS = ",".join(f"('{code}',{step},{str(server).lower()})" for code, step, server in C.ROADMAP)


@query(f"""WITH f AS ({SQL["finding_table"]}), j AS (SELECT code, lane, severity, count, CAST(coalesce(step,99) AS INT) AS step, coalesce(server,false) AS server, CAST(list_position(['critical','warn','info'],severity)-1 AS INT) AS rank FROM f LEFT JOIN (VALUES {_STEPS}) s(code,step,server) USING (code))
 SELECT *, CAST(row_number() OVER (ORDER BY rank, step, code) AS INT) AS ord FROM j""")
def roadmap_order(spark, d):
    return rules.roadmap(rules.page_findings(_page_table(spark, d)))


# ---- robots, links, crawl -------------------------------------------------------------------------------------------

AGENTS = ("GPTBot", "Yeti")

_RULES = f"""p AS (SELECT page_id, {HOST} AS site, {PATH} AS path, {PATH}||CASE WHEN regexp_extract(url,'{PARTS}',4)<>'' THEN '?'||regexp_extract(url,'{PARTS}',4) ELSE '' END AS target FROM pages),
 u AS (SELECT site, 'GPTBot' AS agent, path, false AS allow, page_id FROM p WHERE page_id%3=0 UNION ALL SELECT site, 'GPTBot', '/'||split_part(path,'/',2)||'/*.html$', true, page_id FROM p WHERE page_id%5=0
 UNION ALL SELECT site, 'GPTBot', '/', false, page_id FROM p WHERE page_id%9=1 UNION ALL SELECT site, '*', left(path,5), false, page_id FROM p WHERE page_id%2=0 UNION ALL SELECT site, '*', '/*?page=', page_id%14=0, page_id FROM p WHERE page_id%7=0
 UNION ALL SELECT site, '*', path||'$', true, page_id FROM p WHERE page_id%4=0),
 a AS (SELECT site, ua FROM (SELECT DISTINCT site FROM p), (VALUES ('GPTBot'),('Yeti')) x(ua)),
 k AS (SELECT site, ua, EXISTS (SELECT 1 FROM u WHERE u.site=a.site AND agent=ua) AS own, EXISTS (SELECT 1 FROM u WHERE u.site=a.site AND agent='*') AS any_star FROM a),
 r AS (SELECT k.site, ua, own, any_star, path, allow, length(replace(replace(path,'$',''),'*','')) AS n, '^'||replace(replace(replace(path,'.','\\.'),'?','\\?'),'*','.*') AS pat FROM k LEFT JOIN u ON u.site=k.site AND u.agent=CASE WHEN own THEN ua ELSE '*' END)"""


def _robots(spark, d):
    return _robots_of(_pages(spark, d))


def _robots_of(pages):
    """site, raw: a robots file of each host, its rules from the paths of the host's pages; some hosts have no group for some."""
    k, path = F.col("page_id"), F.col("path")
    rule = lambda test, agent, line: F.when(test, F.struct(F.lit(agent).alias("agent"), k.alias("page_id"), line.alias("line")))
    wild = F.concat(F.lit("/"), F.element_at(F.split("path", "/"), 2), F.lit("/*.html$"))
    pages = pages.select(U.host_of("url").alias("site"), k, U.part("url", 3).alias("path"))
    lines = F.array_compact(F.array(
        rule(k % 3 == 0, "GPTBot", F.concat(F.lit("Disallow: "), path)), rule(k % 5 == 0, "GPTBot", F.concat(F.lit("allow:"), wild)), rule(k % 9 == 1, "GPTBot", F.lit("Disallow: / # all")),
        rule(k % 2 == 0, "*", F.concat(F.lit("Disallow:"), F.substring("path", 1, 5))), rule(k % 7 == 0, "*", F.concat(F.when(k % 14 == 0, "Allow").otherwise("Disallow"), F.lit(": /*?page="))),
        rule(k % 4 == 0, "*", F.concat(F.lit("Allow: "), path, F.lit("$")))))
    groups = pages.select("site", F.explode(lines).alias("l")).groupBy("site", "l.agent").agg(F.array_sort(F.collect_list(F.struct("l.page_id", "l.line"))).alias("l"))
    text = F.concat(F.lit("User-agent: "), "agent", F.lit("\n"), F.array_join(F.col("l.line"), "\n"), F.lit("\n"))
    raw = groups.groupBy("site").agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("raw"))
    return pages.select("site").distinct().join(raw, "site", "left").select("site", F.coalesce("raw", F.lit("")).alias("raw"))


def _crawlers(spark, d):
    return _pages(spark, d).select(U.host_of("url").alias("site")).distinct().select("site", F.explode(F.array(*map(F.lit, AGENTS))).alias("ua"))


@query(f"""WITH {_RULES}, e AS (SELECT site, ua, own, any_star, coalesce(arg_max(allow, n*2+allow::INT) FILTER (regexp_matches('/', pat)), true) AS open, coalesce(bool_or(allow),false) AS any_allow, coalesce(bool_or(path<>'/'),false) AS other FROM r GROUP BY 1,2,3,4)
 SELECT site, ua, CASE WHEN own THEN 'explicit-' WHEN any_star THEN 'star-' ELSE 'none' END||CASE WHEN NOT own AND NOT any_star THEN '' WHEN NOT open THEN CASE WHEN any_allow THEN 'partial' ELSE 'block' END WHEN other THEN 'partial' ELSE 'allow' END AS policy FROM e""")
def robots_policy_matrix(spark, d):
    return R.policies(R.rules_table(_robots(spark, d)), _crawlers(spark, d))


@query(f"""WITH {_RULES} SELECT t.site, r.ua, t.target, coalesce(arg_max(allow, n*2+allow::INT) FILTER (regexp_matches(t.target, pat)), true) AS allowed
 FROM (SELECT DISTINCT site, target FROM p) t JOIN r USING (site) GROUP BY 1,2,3""")
def robots_allowed(spark, d):
    """Every path of the pages against the rules of its host."""
    targets = _pages(spark, d).select(U.host_of("url").alias("site"), U.target_of("url").alias("target")).distinct()
    return R.allowed(R.rules_table(_robots(spark, d)), targets.join(_crawlers(spark, d), "site"))


@query(f"""WITH {_RULES} SELECT DISTINCT site, CASE WHEN allow THEN 'Allow: ' ELSE 'Disallow: ' END||path AS line FROM u WHERE agent='*' AND page_id%6=0 EXCEPT SELECT site, CASE WHEN allow THEN 'Allow: ' ELSE 'Disallow: ' END||path FROM u WHERE agent='*' AND page_id%6<>0""")
def robots_lost_lines(spark, d):
    """Rules for every crawler that a draft without those of every sixth page would lose."""
    rules_of = R.rules_table(_robots(spark, d)).where("agent = '*'").select("site", F.concat(F.when(F.col("allow"), "Allow: ").otherwise("Disallow: "), "path").alias("line")).distinct()
    kept = R.rules_table(_robots_of(_pages(spark, d).where("page_id % 6 <> 0"))).where("agent = '*'").select("site", F.concat(F.when(F.col("allow"), "Allow: ").otherwise("Disallow: "), "path").alias("line"))
    return rules_of.join(kept, ["site", "line"], "left_anti")


_LINKS = f"""l AS (SELECT {NORM} AS url, page_id, h.pos, h.href FROM (SELECT url, page_id, unnest(list_transform(regexp_extract_all(html,'<a href="([^"]*)"',1), lambda x, i: {{'pos': i, 'href': x}})) AS h FROM pages)),
 e AS (SELECT DISTINCT url AS src, href AS dst FROM l UNION SELECT href, arg_max(url, page_id) FROM l GROUP BY 1)"""


def _links(spark, d):
    """src, dst, pos: from each page to what it names, and from a name to the last page that has it."""
    l = _pages(spark, d).select(U.normalize("url").alias("src"), "page_id", F.posexplode(P.hrefs("html")).alias("pos", "dst"))
    back = l.groupBy(F.col("dst").alias("src")).agg(F.max_by("src", "page_id").alias("dst")).withColumn("pos", F.lit(0))
    return l.select("src", "dst", "pos").unionByName(back)


@query(f"WITH RECURSIVE {_LINKS}, r(url,depth) AS (SELECT {NORM}, 0 FROM pages WHERE page_id=0 UNION SELECT e.dst, r.depth+1 FROM r JOIN e ON r.url=e.src WHERE r.depth<24) SELECT url, CAST(min(depth) AS INT) AS depth FROM r GROUP BY 1")
def crawl_bfs_levels(spark, d):
    """What can be reached from the first page, and in how many steps."""
    seeds = _pages(spark, d).where("page_id = 0").select(U.normalize("url").alias("url"), F.lit(0).alias("pos"))
    return P.reach(_links(spark, d), seeds).select("url", "depth")


@query("SELECT ua, count(*) AS n FROM (VALUES ('GET / gptbot/1.0'),('GET /a GPTBot'),('x PerplexityBot y'),('none')) t(v), (VALUES ('GPTBot'),('PerplexityBot'),('Yeti')) u(ua) WHERE contains(lower(v), lower(ua)) GROUP BY 1")
def ai_bot_tally(spark, d):
    return P.bot_tally(spark.sql("SELECT * FROM VALUES ('GET / gptbot/1.0'),('GET /a GPTBot'),('x PerplexityBot y'),('none') AS t(value)"))


_VISIBLE = "('p1','What is it? It costs 12,000 won','What is it?'),('p1','What is it? It costs 12,000 won','12000'),('p1','What is it? It costs 12,000 won','15000'),('p2','hello','bye')"


@query(f"SELECT url, needle FROM (VALUES {_VISIBLE}) t(url,text,needle) WHERE NOT contains(text, needle) AND NOT coalesce(contains(text, format('{{:,}}', try_cast(needle AS BIGINT))), false)")
def visible_text_misses(spark, d):
    t = spark.sql(f"SELECT * FROM VALUES {_VISIBLE} AS t(url,text,needle)")
    return t.where(~F.exists(X.price_forms("needle"), lambda n: F.col("text").contains(n))).select("url", "needle")


@query("""WITH b AS (SELECT page_id AS k, 'u'||page_id AS url, page_id%4=0 AS broken FROM pages)
 SELECT url, 0 AS block, true AS valid, 'Product' AS types, '[["Product"], "/a", "A'||k||'", [["'||k||'", "", ""]]]' AS identity, '' AS org_ids, 'A'||k||'|'||k AS visible FROM b WHERE NOT broken
 UNION ALL SELECT url, 0, true, 'Organization|X', '[["Organization"], "#o'||k||'", "N", ""]', '#o'||k, 'N' FROM b WHERE NOT broken UNION ALL SELECT url, 1, false, '', NULL, '', '' FROM b WHERE broken""")
def jsonld_objects(spark, d):
    """Two objects a page in one block, one inside a graph; one page in four has an empty list and a broken block instead."""
    k = F.col("page_id")
    good = F.format_string('[{"@type":"Product","name":"A%d","url":"/a","offers":{"@type":"Offer","price":"%d"}},{"@graph":[{"@type":["Organization","X"],"@id":"#o%d","name":"N"}]}]', k, k, k)
    pages = _pages(spark, d).select(F.concat(F.lit("u"), k.cast("string")).alias("url"), F.when(k % 4 == 0, F.array(F.lit("[]"), F.lit("{broken"))).otherwise(F.array(good)).alias("ld"))
    rows = html.ld_table(pages).where("valid or block = 1")
    return rows.withColumns({c: F.array_join(c, "|") for c in ("types", "org_ids", "visible")})


_TEXT = r"regexp_replace(html, '(?s)<!--.*?-->|<(style|script)[ >].*?</(style|script)>', '', 'g')"
_TEXT = rf"replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace({_TEXT}, '(?s)<[^>]*>', '', 'g'),'&nbsp;',chr(160)),'&copy;','©'),'&middot;','·'),'&quot;','x'),'&#39;','x'),'&lt;','x'),'&gt;','x'),'&amp;','x'),chr(160),' ')"


@query(rf"""SELECT page_id, {TITLE} AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '<a href="')) AS links,
 length(trim(regexp_replace({_TEXT}, '\s+', ' ', 'g'))) AS text_chars, len(regexp_extract_all(html, '<h1>')) AS h1 FROM pages""")
def parsed_pages(spark, d):
    got = html.parse_html(_pages(spark, d).select("page_id", F.col("html").alias("body")))
    return got.select("page_id", "page.title", "page.lang", F.size("page.links").alias("links"), "page.text_chars", F.size("page.h1").alias("h1"))


@query("SELECT host, CASE WHEN host IN ('localhost') OR regexp_matches(host,'^[0-9.]+$') OR NOT contains(host,'.') THEN NULL WHEN starts_with(host,'www.') THEN substr(host,5) ELSE 'www.'||host END AS alternate, regexp_replace(host,'[:*?\"<>|\\\\/]','_','g') AS file FROM (VALUES ('www.a.com'),('a.com'),('localhost'),('10.0.0.1'),('intranet')) t(host)")
def host_forms(spark, d):
    t = spark.sql("SELECT * FROM VALUES ('www.a.com'),('a.com'),('localhost'),('10.0.0.1'),('intranet') AS t(host)")
    return t.select("host", U.alternate_host("host").alias("alternate"), U.safe_host("host").alias("file"))


# ---- what a fetch brings back, sentences ----------------------------------------------------------------------------

@query("SELECT event_id, 'text/html' AS content_type, 'noindex'||chr(10)||'bot: '||event_type AS robots_tag, 'a=1, b='||user_id AS cookies, 3 AS n FROM events")
def response_headers(spark, d):
    """Headers of one response an event, names in mixed case, some repeated, one without a value."""
    h = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    pairs = F.array(
        h("Content-Type", F.lit(" text/html ")), h("X-Robots-Tag", F.lit("noindex")), h("Set-Cookie", F.lit("a=1")), h("x-robots-tag", F.concat(F.lit("bot: "), "event_type")),
        h("SET-COOKIE", F.concat(F.lit("b="), F.col("user_id").cast("string"))), h("Empty", F.lit(None).cast("string")))
    got = S.table(spark, d, "events").select("event_id", H.headers(pairs).alias("m"))
    return got.select("event_id", F.col("m")["content-type"].alias("content_type"), F.col("m")["x-robots-tag"].alias("robots_tag"), F.col("m")["set-cookie"].alias("cookies"), F.size("m").alias("n"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'tls_fail' WHEN 'click' THEN 'dns_fail' WHEN 'view' THEN 'timeout' WHEN 'signup' THEN NULL ELSE 'error: '||event_type END AS failure FROM events""")
def fetch_failures(spark, d):
    e = F.col("event_type")
    kind = F.when(e == "error", "SSLCertVerificationError").when(e == "click", "gaierror").when(e == "view", "TimeoutError").when(e == "signup", None).otherwise("ConnectionResetError")
    return S.table(spark, d, "events").select("event_id", H.failure(kind, e).alias("failure"))


@query(f"""SELECT page_id, CASE WHEN page_id%12>10 THEN 'error: too many redirects' WHEN page_id%5=0 THEN 'external_redirect_blocked' WHEN NOT starts_with({HOST},'t') THEN 'external_redirect_blocked'
 WHEN page_id%3=0 THEN 'redirect_blocked_by_robots' END AS error FROM (SELECT page_id, CASE WHEN starts_with({HOST},'t') THEN url ELSE 'https://elsewhere.example/' END AS url FROM pages)""")
def redirect_guard(spark, d):
    """Each page as the target of a redirect from its own host, from another one, by another scheme, after many hops."""
    p = _pages(spark, d).withColumn("origin", U.host_of("url"))
    target = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("ftp://"), "origin")).when(F.col("origin").startswith("t"), F.col("url")).otherwise("https://elsewhere.example/")
    return p.select("page_id", H.redirect_error(F.col("page_id") % 12, target, "origin", F.col("page_id") % 3 != 0).alias("error"))


@query("""SELECT doc_id, CASE doc_id%4 WHEN 0 THEN (doc_id%9)||' pages lack a title.' WHEN 1 THEN lang||' pages share a title with another.' WHEN 2 THEN 'stored '||source
 ELSE 'The home page is '||n_chars||' redirects away.' END AS message FROM documents""")
def finding_messages(spark, d):
    """One finding a document: count by its URLs, data that a sentence names, data that lack it, counts that data override."""
    k = F.col("doc_id") % 4
    rows = S.table(spark, d, "documents").select(
        "doc_id", F.when(k == 0, "TITLE_MISSING").when(k == 1, "TITLE_DUPLICATE").when(k == 2, "SOFT_404").otherwise("REDIRECT_HOPS").alias("code"),
        F.array_repeat(F.lit("u"), (F.col("doc_id") % 9).cast("int")).alias("urls"),
        F.when(k == 1, F.create_map(F.lit("pages"), "lang")).when(k == 3, F.create_map(F.lit("hops"), F.col("n_chars").cast("string"), F.lit("count"), F.lit("x"))).alias("data"),
        F.concat(F.lit("stored "), "source").alias("message"))
    return N.with_messages(rows).select("doc_id", "message")


@query("""SELECT doc_id, CASE doc_id%3 WHEN 0 THEN 'pages '||n_chars||' · duplicate titles 0 · JSON-LD 2 · noindex 0 · sitemap URLs '||doc_id WHEN 1 THEN 'brand 0/'||n_chars||' · nonbrand 2/0' ELSE 'fail 0 · warn 0 · pass '||doc_id END AS line,
 CASE WHEN doc_id%7=0 THEN '—' ELSE cast(round_even(100.0*((doc_id%101)/100.0),0) AS bigint)||'%' END AS share FROM documents""")
def snapshot_lines(spark, d):
    i = F.col("doc_id")
    kind = F.when(i % 3 == 0, "audit").when(i % 3 == 1, "measure").otherwise("verify")
    figures = F.create_map(F.lit("pages"), F.col("n_chars").cast("long"), F.lit("jsonld_pages"), F.lit(2).cast("long"), F.lit("sitemap_urls"), i, F.lit("brand_runs"), F.col("n_chars").cast("long"), F.lit("nonbrand_cited"), F.lit(2).cast("long"), F.lit("pass"), i)
    return S.table(spark, d, "documents").select("doc_id", N.snapshot_line(kind, figures).alias("line"), N.percent(F.when(i % 7 != 0, (i % 101) / 100)).alias("share"))


@query("SELECT doc_id, coalesce(contains(lower(text),'der') OR contains(lower(text),lower(source)||'.example'),false) AS hit FROM documents")
def brand_hits(spark, d):
    docs = S.table(spark, d, "documents")
    return docs.select("doc_id", N.brand_hit("text", F.concat(F.lit("https://www."), "source", F.lit(".example/")), F.lit("Der")).alias("hit"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'gemini,claude' ELSE 'chatgpt,google_aio' END AS engines, CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN '' ELSE event_type END AS ignored FROM events""")
def engine_picks(spark, d):
    e = F.col("event_type")
    raw = F.when(e == "click", "Gemini, Click; claude|GEMINI").when(e == "view", F.lit(None).cast("string")).otherwise(e)
    got = S.table(spark, d, "events").select("event_id", N.pick_engines(raw).alias("p"))
    return got.select("event_id", F.array_join("p.engines", ",").alias("engines"), F.array_join("p.ignored", ",").alias("ignored"))


# ---- what is written is read again; inputs are judged -------------------------------------------------------------------

@query(f"""WITH {_LOG}, o AS (SELECT *, row_number() OVER (PARTITION BY date,query_id,engine,run_no,locale,coalesce(CAST(search_enabled AS VARCHAR),'') ORDER BY event_id%3 DESC, event_id) AS rn FROM raw)
 SELECT CAST(event_id AS VARCHAR) AS note, date, query_id, engine, run_no, locale, outcome FROM o WHERE rn=1""")
def log_append_order(spark, d):
    """A log of many files, in no order of time: of the rows of a key the one in the last line of the last file counts."""
    key, path = F.col("event_id"), scratch.folder(spark, "log")
    rows = S.log(spark, d).withColumn("note", key.cast("string")).orderBy(key % 3, key.desc())  # one file a range, names in order
    sinks.append_log(rows.select(*spark.createDataFrame([], C.LOG).columns), path)
    return M.last_wins(tables.read_log(spark, path), "file", "line").select("note", "date", "query_id", "engine", "run_no", "locale", "outcome")


@query(f"""WITH {_LOG} SELECT date, query_id, engine, outcome, count(*) AS n, CAST(sum(CASE WHEN event_id%5<>3 THEN len(cited_urls) ELSE 0 END) AS BIGINT) AS urls FROM raw WHERE event_id%5<>4 AND event_id%7<>0 GROUP BY 1,2,3,4""")
def log_round_trip(spark, d):
    """The log appended in two parts and read again; rows of an unknown version or engine, and broken lines, are left out."""
    key, path = F.col("event_id"), scratch.folder(spark, "log")
    rows = S.log(spark, d).withColumns({
        "schema": F.when(key % 5 == 4, "sitewright/measure-row/9").otherwise("sitewright/measure-row/2"), "engine": F.when(key % 7 == 0, "unheard").otherwise(F.col("engine")),
        "cited_urls": F.when(key % 5 == 3, F.expr("cast(array() as array<string>)")).otherwise(F.col("cited_urls"))})
    own = spark.createDataFrame([], C.LOG).columns
    for part in (0, 1):
        sinks.append_log(rows.where(key % 2 == part).select(*own), path)
    spark.createDataFrame([("{broken",), ("",), ("[]",)], "value string").write.mode("append").text(path)
    read = tables.read_log(spark, path)
    return read.groupBy("date", "query_id", "engine", "outcome").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("cited_urls")), F.lit(0)).cast("long").alias("urls"))


_GREEDY = f"""o AS (SELECT url, row_number() OVER (ORDER BY url) AS i, strlen(url)+40 AS size FROM (SELECT DISTINCT {NORM} AS url FROM pages)),
 g(i,url,chunk,n,used) AS (SELECT i, url, 0, 1, size FROM o WHERE i=1 UNION ALL SELECT o.i, o.url, g.chunk+CAST(n>=40 OR used+size>3000 AS INT), CASE WHEN n>=40 OR used+size>3000 THEN 1 ELSE n+1 END,
 CASE WHEN n>=40 OR used+size>3000 THEN size ELSE used+size END FROM g JOIN o ON o.i=g.i+1)"""


def _urls(spark, d):
    return _pages(spark, d).select(U.normalize("url").alias("url")).distinct()


@query(f"WITH RECURSIVE {_GREEDY} SELECT url, CAST(chunk AS BIGINT) AS chunk FROM g")
def sitemap_chunks_by_bytes(spark, d):
    """Greedy chunks of at most 40 URLs and 3000 bytes, from blocks of 64."""
    return P.sitemap_chunks(_urls(spark, d), 40, 3000, block=64)


@query(f"""WITH RECURSIVE {_GREEDY} SELECT 'sitemap-'||(chunk+1)||'.xml' AS file, 'urlset' AS kind, url FROM g
 UNION ALL SELECT DISTINCT 'sitemap_index.xml', 'sitemapindex', 'https://s.example/a&b/sitemap-'||(chunk+1)||'.xml' FROM g""")
def sitemap_files(spark, d):
    """Sitemap files by count and bytes with their index, written and parsed again."""
    path = scratch.folder(spark, "sitemaps")
    G.sitemap_files(_urls(spark, d), path, "https://s.example/a&b", most=40, most_bytes=3000, block=64)
    # input_file_name() is the file that the scan has come to, which runs ahead of the rows that Python gives back
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), html.parse_sitemap("value").alias("s"))
    return files.where("s.parsed").select("file", F.when(F.col("s.is_index"), "sitemapindex").otherwise("urlset").alias("kind"), F.explode("s.locs").alias("url"))


@query(f"SELECT page_id, {NORM} AS url, CASE WHEN page_id%13<>0 THEN {TITLE} END AS draft_title FROM pages")
def meta_files(spark, d):
    """Meta drafts written and read again."""
    drafts = _page_table(spark, d).select(F.col("pos").alias("page_id"), "url", F.col("title").alias("draft_title"))
    path = scratch.folder(spark, "meta")
    sinks.write_meta(drafts, path)
    return spark.read.schema(drafts.schema).json(f"{path}/meta-draft.json")


@query("SELECT ['audit','measure','verify'][user_id%3+1] AS kind, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) + CASE WHEN user_id%3=1 THEN 1000 ELSE 0 END AS n FROM events GROUP BY 1,2,user_id%3")
def snapshot_store(spark, d):
    """Snapshots by kind and date; those of one kind are replaced by force, what may not be stored changes nothing."""
    kind = F.get(F.array(*map(F.lit, C.SNAPSHOT_KINDS)), (F.col("user_id") % 3).cast("int"))
    rows = S.table(spark, d, "events").groupBy(kind.alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("n"))
    rows = rows.select("kind", "date", F.lit("s.example").alias("host"), F.concat(F.lit("x/"), "kind", F.lit("/1")).alias("schema"), "n")
    path = scratch.folder(spark, "snapshots")
    snapshots.write(rows, path, "s.example")
    more = rows.withColumn("n", F.col("n") + 1000)
    for wrong in (more, more.withColumn("host", F.lit("t.example"))):  # exists already; another site's
        try:
            snapshots.write(wrong, path, "s.example", force=wrong is not more)
        except (FileExistsError, ValueError):
            continue
        raise AssertionError("stored what it must not")
    snapshots.write(more.where("kind = 'measure'"), path, "s.example", force=True)
    return snapshots.read(spark, path, rows.schema).join(snapshots.damaged(spark, path, rows.schema), ["kind", "date"], "left_anti").select("kind", "date", "n")


@query("""SELECT event_id, CASE WHEN event_type='error' THEN '' WHEN event_id%2=0 THEN 'https://a.example/'||(event_id%5)||' https://b.example/' ELSE 'https://c.example/'||user_id END AS cited_urls,
 CASE WHEN event_type='error' THEN '' WHEN event_id%2=0 THEN 'said '||user_id||'.' ELSE 'told '||event_id||'!' END AS text, CASE WHEN event_type='error' THEN 'timeout' END AS error FROM events""")
def stored_answers(spark, d):
    """Stored answers of two services: cited URLs once each, what is no citation left out, errors kept."""
    e = S.table(spark, d, "events").select("event_id", "user_id", "event_type")
    first = F.format_string('{"output":[{"type":"search"},{"content":[{"text":"said ","annotations":[{"type":"url_citation","url":"https://a.example/%d"},{"type":"file","url":"https://no.example/"}]},{"text":"%d.","annotations":[{"type":"url_citation","url":"https://b.example/"},{"type":"url_citation","url":"https://b.example/"}]}]}]}', F.col("event_id") % 5, F.col("user_id"))
    second = F.format_string('{"content":[{"type":"tool","text":null},{"type":"text","text":"told ","citations":[{"url":"https://c.example/%d"}]},{"type":"text","text":"%d!"}]}', F.col("user_id"), F.col("event_id"))
    failed, even = F.col("event_type") == "error", F.col("event_id") % 2 == 0
    error = F.lit('{"_error":"timeout"}')
    sides = (("openai", e.where(even), first), ("anthropic", e.where(~even), second))
    parsed = [tables.parse_answer(rows.withColumn("body", F.when(failed, error).otherwise(body)), kind) for kind, rows, body in sides]
    return parsed[0].unionByName(parsed[1]).select("event_id", F.array_join("cited_urls", " ").alias("cited_urls"), "text", "error")


@query("""WITH r AS (SELECT 'q'||(doc_id%500) AS id, CASE WHEN doc_id%7=0 THEN '  ' ELSE 'about '||source||' '||doc_id END AS text, CASE doc_id%3 WHEN 0 THEN 'brand' WHEN 1 THEN 'nonbrand' ELSE 'odd' END AS type,
 row_number() OVER (PARTITION BY doc_id%500 ORDER BY doc_id) AS rn FROM documents) SELECT id, text, type, sha256(type||chr(10)||text) AS fingerprint FROM r WHERE rn=1 AND type<>'odd' AND trim(text)<>''""")
def question_set(spark, d):
    """The first of each id counts, even if it is blank or of no known type."""
    k = F.col("doc_id")
    raw = S.table(spark, d, "documents").select(
        k.alias("pos"), F.concat(F.lit("q"), (k % 500).cast("string")).alias("id"), F.when(k % 7 == 0, "  ").otherwise(F.concat_ws(" ", F.lit("about"), "source", k.cast("string"))).alias("text"),
        F.when(k % 3 == 0, "brand").when(k % 3 == 1, "nonbrand").otherwise("odd").alias("type"), F.lit(None).cast("string").alias("note"))
    return tables.query_set(raw).select("id", "text", "type", "fingerprint")


@query("SELECT page_id, page_id%3<>0 AND page_id%4<>0 AS present, CASE WHEN page_id%3<>0 AND page_id%4<>0 THEN 'User-agent: '||page_id ELSE '' END AS raw FROM pages")
def robots_bodies(spark, d):
    """A robots file counts with status 200 and if it is no page."""
    k = F.col("page_id")
    body = F.when(k % 4 == 0, F.concat(F.lit("  "), "html")).otherwise(F.concat(F.lit("User-agent: "), k.cast("string")))
    got = tables.robots_body(_pages(spark, d).select(k.cast("string").alias("url"), F.when(k % 3 == 0, 503).otherwise(200).alias("status"), body.alias("body")))
    return got.select(F.col("url").cast("long").alias("page_id"), "present", "raw")


@query("SELECT type, count(*) AS n FROM (SELECT unnest(CASE page_id%3 WHEN 0 THEN ['FAQPage'] WHEN 1 THEN ['FAQPage','Product'] ELSE ['T'||(page_id%5)] END) AS type FROM pages WHERE page_id%17<>0) GROUP BY 1")
def jsonld_type_counts(spark, d):
    """Pages with each type, a page once however often it names the type."""
    k = F.col("page_id")
    kinds = F.when(k % 3 == 0, F.array(F.lit("FAQPage"), F.lit("FAQPage"))).when(k % 3 == 1, F.array(F.lit("FAQPage"), F.lit("Product"))).otherwise(F.array(F.concat(F.lit("T"), (k % 5).cast("string"))))
    return rules.type_histogram(_pages(spark, d).select(F.when(k % 17 == 0, 404).otherwise(200).alias("status"), kinds.alias("jsonld_types")))


@query("SELECT count(*) FILTER (doc_id%5=0) AS critical, count(*) FILTER (doc_id%5 IN (1,2)) AS warn, count(*) FILTER (doc_id%5>2) AS info FROM documents")
def severity_totals(spark, d):
    k = F.col("doc_id") % 5
    return rules.severity_counts(S.table(spark, d, "documents").select(F.when(k == 0, "critical").when(k <= 2, "warn").otherwise("info").alias("severity")))


_REASONS = (
    ("max_pages_reached", "k%2=0"), ("discovery_queue_truncated", "k%4=0"), ("seed_blocked_by_robots", "k%3=0"), ("network_errors", "k%5=0"), ("http_errors", "k%7=0"),
    ("no_pages_fetched", "k%11=0"), ("robots_unavailable", "k%13=0"), ("sitemap_invalid", "k%17=0"), ("sitemap_truncated", "k%19=0"),
)


@query(f"SELECT k AS crawl_id, concat_ws(' ', {', '.join(f'CASE WHEN {test} THEN {chr(39)}{name}{chr(39)} END' for name, test in _REASONS)}) AS reasons, NOT ({' OR '.join(test for _, test in _REASONS)}) AS complete FROM (SELECT page_id AS k FROM pages)")
def coverage_reasons(spark, d):
    """Counters of one crawl a page_id, every reason for an incomplete crawl in its order."""
    k = F.col("page_id")
    hit = lambda n: (k % n == 0).cast("int")
    c = _pages(spark, d).select(
        k.alias("crawl_id"), hit(2).alias("queued_remaining"), (k % 4 == 0).alias("queue_truncated"), hit(3).alias("blocked_seeds"), hit(5).alias("network_errors"), hit(7).alias("http_errors"),
        F.when(k % 11 == 0, 0).otherwise(9).alias("pages_fetched"), (k % 13 == 0).alias("robots_unavailable"), hit(17).alias("sitemap_invalid"), hit(19).alias("sitemap_truncated"))
    return rules.coverage(c).select("crawl_id", F.array_join("reasons", " ").alias("reasons"), "complete")
