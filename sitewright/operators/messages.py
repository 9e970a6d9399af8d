"""Sentences for people: what a finding says, one line about a snapshot, and the orders in which rows are shown."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import text as X

# {name} stands for an entry of the finding's data; count is the number of its URLs unless data has one.
SENTENCES = {
    "NOINDEX": "{count} pages are kept out of the index.", "INTENTIONAL_NOINDEX": "{count} pages are kept out of the index on purpose.",
    "SNIPPET_RESTRICTED": "{count} pages limit their snippets.", "TITLE_DUPLICATE": "{pages} pages share a title with another.",
    "TITLE_MISSING": "{count} pages lack a title.", "TITLE_TOO_LONG": "{count} titles are longer than is shown.",
    "TITLE_TOO_SHORT": "{count} titles say too little.", "DESC_DUPLICATE": "{pages} pages share a description with another.",
    "DESC_MISSING": "{count} pages lack a description.", "DESC_TOO_LONG": "{count} descriptions are longer than is shown.",
    "DESC_TOO_SHORT": "{count} descriptions say too little.", "JSONLD_MISSING": "{count} pages hold no JSON-LD.",
    "FAQ_MISSING": "No page marks up questions and answers.", "ORG_JSONLD_MISSING": "No page names its organization in JSON-LD.",
    "ORG_JSONLD_SCATTERED": "{count} pages each name an organization; one @id would do.", "CANONICAL_MISSING": "{count} pages lack a canonical address.",
    "CANONICAL_NOT_SELF": "{count} canonical addresses point to another page.", "H1_MISSING": "{count} pages lack a main heading.",
    "H1_MULTIPLE": "{count} pages have several main headings.", "THIN_TEXT": "{count} pages show little text without scripts.",
    "HTTP_ERROR": "{count} linked addresses answer with an error.", "ROBOTS_MISSING": "There is no usable robots.txt.",
    "SITEMAP_NOT_DECLARED": "robots.txt names no sitemap.", "SITEMAP_MISSING": "No sitemap can be reached.",
    "SITEMAP_CRAWL_MISMATCH": "{only_in_sitemap} addresses are in the sitemap alone, {only_in_crawl} in the crawl alone.",
    "LLMS_TXT_MISSING": "There is no llms.txt.", "SOFT_404": "An address that does not exist answers {status}.",
    "REDIRECT_HOPS": "The home page is {hops} redirects away.", "ALT_HOST_UNREACHABLE": "{host} cannot be reached ({result}).",
    "NAVER_VERIFY_MISSING": "No page carries a Naver verification.", "AI_CRAWLER_BLOCKED": "Crawlers of answer engines are kept out.",
    "AI_CRAWLER_PARTIAL": "Crawlers of answer engines are kept out of parts.", "AI_TRAINING_BLOCKED": "Crawlers for training are kept out.",
    "AI_CRAWLER_UNDECLARED": "robots.txt does not name the crawlers of answer engines.",
    "NAVER_CRAWLER_BLOCKED": "Korean search crawlers are kept out.", "CRAWL_INCOMPLETE": "The crawl did not see the whole site.",
}


def with_messages(findings: DataFrame) -> DataFrame:
    """Findings (code, urls, data, message) with `message` made from the sentence of the code; the stored message stays where there is
    no sentence, or where the data lack what it names."""
    table = findings.sparkSession.createDataFrame(list(SENTENCES.items()), "code string, _sentence string")
    data = F.coalesce("data", F.expr("cast(map() as map<string,string>)"))
    count = F.create_map(F.lit("count"), F.coalesce(F.size("urls"), F.lit(0)).cast("string"))
    data = F.when(F.map_contains_key(data, "count"), data).otherwise(F.map_concat(data, count))
    needed = F.regexp_extract_all("_sentence", F.lit(r"\{(\w+)\}"), 1)
    filled = F.aggregate(needed, F.col("_sentence"), lambda s, k: F.replace(s, F.concat(F.lit("{"), k, F.lit("}")), F.element_at(F.col("_data"), k)))
    rows = findings.join(F.broadcast(table), "code", "left").withColumn("_data", data)  # one row a code
    return rows.withColumn("message", F.coalesce(filled, "message")).drop("_sentence", "_data")


def snapshot_line(kind, values) -> Column:
    """One line about a snapshot from a map of its figures; what is missing counts as 0."""
    v = lambda name: F.coalesce(F.element_at(X.col(values), name), F.lit(0)).cast("long")
    k = X.col(kind)
    return (
        F.when(k == "audit", F.format_string("pages %d · duplicate titles %d · JSON-LD %d · noindex %d · sitemap URLs %d", *map(v, ("pages", "dup_titles", "jsonld_pages", "noindex", "sitemap_urls"))))
        .when(k == "measure", F.format_string("brand %d/%d · nonbrand %d/%d", *map(v, ("brand_cited", "brand_runs", "nonbrand_cited", "nonbrand_runs"))))
        .when(k == "verify", F.format_string("fail %d · warn %d · pass %d", *map(v, ("fail", "warn", "pass")))))


def percent(rate) -> Column:
    """A rate as whole percent, half to even; a dash without one."""
    return F.coalesce(F.concat(F.bround(X.col(rate) * 100).cast("long").cast("string"), F.lit("%")), F.lit("—"))


def place_in(value, order) -> Column:
    """The place of a value in a short fixed order, after the last one if it is not in it."""
    return F.coalesce(*[F.when(X.col(value) == v, i) for i, v in enumerate(order)], F.lit(len(order)))


def checks_in_order(checks: DataFrame) -> DataFrame:
    """Failures first, equal ones as they came (`pos`)."""
    return checks.orderBy(place_in("status", C.CHECK_ORDER), "pos")


def log_in_order(log: DataFrame) -> DataFrame:
    return log.orderBy("date", "query_id", "engine", "run_no")


def snapshots_in_order(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy("date", place_in("kind", C.SNAPSHOT_KINDS))


def brand_hit(text, host, name) -> Column:
    """Whether a text names the site or its host (without www), in any case."""
    from ..functions import urls as U

    low = F.lower(F.coalesce(X.col(text), F.lit("")))
    has = lambda needle: F.coalesce((needle != "") & low.contains(F.lower(needle)), F.lit(False))
    return has(X.col(name)) | has(U.bare_domain(host))


def pick_engines(raw) -> Column:
    """struct(engines, ignored) from a list in one text: the known engines in order of naming, else the two usual ones."""
    tokens = X.split_multi(raw)
    known = lambda t: F.lower(t).isin(*C.ENGINES)
    want = F.array_distinct(F.transform(F.filter(tokens, known), F.lower))
    return F.struct(F.when(F.size(want) > 0, want).otherwise(F.array(*map(F.lit, C.DEFAULT_ENGINES))).alias("engines"), F.filter(tokens, lambda t: ~known(t)).alias("ignored"))
