"""Files for a site from its page table and company facts: sitemaps, robots, llms.txt, JSON-LD, meta drafts.

Tables are planned by Spark; the text of a document is put together on the driver only where the document itself is
small (one robots file, one llms.txt).  Nothing is invented: an unknown value is left out or marked as to do."""
from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import text as X
from ..functions import urls as U
from ..operators import pages as P
from ..operators import rules
from ..sources import sinks

NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"  # fixed value


def safe_to_replace(complete: bool | None, known: DataFrame, eligible: DataFrame) -> tuple[bool, DataFrame]:
    """Whether a new sitemap may replace the old one, and the known URLs that it would lose.  An audit that did not see
    everything never may; one without coverage only if nothing is lost."""
    lost = known.select("url").distinct().join(eligible.select("url"), "url", "left_anti")
    if complete is None:
        return not lost.limit(1).count(), lost
    return complete, lost


def sitemap_files(urls: DataFrame, path: str, base: str, **limits) -> list[str]:
    """The sitemap of one site written to path: sitemap.xml, or its parts and sitemap_index.xml; the names."""
    return sinks.write_sitemaps(P.sitemap_chunks(urls, **limits), path, NAMESPACE, base)


def robots_plan(policies: DataFrame) -> DataFrame:
    """ua, policy, action: declare (allowed by nothing said), copy (kept out of parts by the rule for all), keep."""
    action = F.when(F.col("policy").isin("none", "star-allow"), "declare").when(F.col("policy") == "star-partial", "copy").otherwise("keep")
    return policies.withColumn("action", action)


def merged_robots(raw: str, plan: list[tuple[str, str]], star_rules: list[tuple[str, bool]], sitemaps: list[str]) -> tuple[str, str]:
    """The original text as it is, then groups for crawlers that are not named, then undeclared sitemaps; and the diff.
    What is blocked stays blocked."""
    added: list[str] = []
    for ua, action in plan:
        if action == "declare":
            added += ["", f"User-agent: {ua}", "Allow: /"]
        elif action == "copy":
            added += ["", f"User-agent: {ua}", *[f"{'Allow' if allow else 'Disallow'}: {path}" for path, allow in star_rules]]
    declared = {line.split(":", 1)[1].strip() for line in raw.splitlines() if line.lower().lstrip().startswith("sitemap:")}
    fresh = [s for s in sitemaps if s not in declared]
    added += [""] * bool(fresh) + [f"Sitemap: {s}" for s in fresh]
    text = raw + ("\n" if raw and not raw.endswith("\n") else "") + "".join(f"{line}\n" for line in added)
    diff = "".join(difflib.unified_diff(raw.splitlines(True), text.splitlines(True), "robots.txt (live)", "robots.txt (new)"))
    return text, diff


def llms_text(name: str, description: str | None, sections: list[dict]) -> str:
    """A short map of the site: one line a section, what is unknown marked as to do."""
    lines = [f"# {name or C.TODO + ': name>>'}", "", f"> {description or C.TODO + ': one sentence on what the site is>>'}", "", "## Sections", ""]
    lines += [f"- [{s['label'] or C.TODO + ': title>>'}]({s['url']})" for s in sections]
    return "\n".join(lines) + "\n"


def _object(kind: str, **fields: Column) -> Column:
    """JSON text of a typed object; empty fields are left out."""
    empty = lambda c: F.when(c.cast("string") != "", c)
    named = [F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type"), *[(v if k.startswith("_") else empty(v)).alias(k.lstrip("_")) for k, v in fields.items()]]
    return F.to_json(F.struct(*named))


def organization(site: DataFrame) -> DataFrame:
    """site: one row (name, legal_name, url, logo, description, same_as array, phone, email, founding_year)."""
    contact = F.when(F.coalesce(X.falsy("phone", F.lit(None)), X.falsy("email", F.lit(None))).isNotNull(), F.struct(F.lit("ContactPoint").alias("@type"), X.falsy("phone", F.lit(None)).alias("telephone"), X.falsy("email", F.lit(None)).alias("email")))
    links = F.when(F.size("same_as") > 0, F.col("same_as"))
    body = _object("Organization", **{"@id": F.concat("url", F.lit("#organization")), "name": F.col("name"), "legalName": F.col("legal_name"), "url": F.col("url"), "logo": F.col("logo"), "description": F.col("description"), "foundingDate": F.col("founding_year"), "_sameAs": links, "_contactPoint": contact})
    return site.where(X.falsy("name", F.lit(None)).isNotNull() & X.falsy("url", F.lit(None)).isNotNull()).select(F.lit("organization.json").alias("name"), F.col("url").alias("page"), X.json_in_html(body).alias("body"))


def faqs(facts: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FAQ files of pages that were seen with status 200, and the facts that were left out with the reason."""
    rows = facts.withColumn("page", U.normalize("page_url")).join(pages.where("status = 200").select(F.col("url").alias("page"), F.lit(True).alias("_seen")).distinct(), "page", "left")
    reason = F.when((X.falsy("q", F.lit(None)).isNull()) | (X.falsy("a", F.lit(None)).isNull()), "empty").when(X.falsy("page_url", F.lit(None)).isNull(), "no_page").when(F.col("_seen").isNull(), "page_not_seen")
    rows = rows.withColumn("reason", reason)
    question = F.struct(F.lit("Question").alias("@type"), F.col("q").alias("name"), F.struct(F.lit("Answer").alias("@type"), F.col("a").alias("text")).alias("acceptedAnswer"))
    grouped = rows.where("reason is null").groupBy("page").agg(F.array_sort(F.collect_list(question)).alias("questions"))
    body = _object("FAQPage", _mainEntity=F.col("questions"))
    return grouped.select(F.concat(U.slug("page"), F.lit("-faq.json")).alias("name"), "page", X.json_in_html(body).alias("body")), rows.where("reason is not null").select("page_url", "q", "reason")


def products(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """Product files; an offer only with price and currency; note: page_not_seen where the page is unknown."""
    rows = facts.where(X.falsy("name", F.lit(None)).isNotNull()).withColumn("page", U.normalize("page_url"))
    rows = rows.join(pages.where("status = 200").select(F.col("url").alias("page"), F.lit(True).alias("_seen")).distinct(), "page", "left")
    has_offer = X.falsy("price", F.lit(None)).isNotNull() & X.falsy("currency", F.lit(None)).isNotNull()
    offer = F.when(has_offer, F.struct(F.lit("Offer").alias("@type"), F.col("price").alias("price"), F.col("currency").alias("priceCurrency")))
    body = _object("Product", name=F.col("name"), description=F.col("description"), url=F.col("page"), _offers=offer)
    return rows.select(F.concat(U.slug("page"), F.lit("-product.json")).alias("name"), "page", X.json_in_html(body).alias("body"), F.when(F.col("_seen").isNull(), "page_not_seen").alias("note"))


def breadcrumb_files(pages: DataFrame) -> DataFrame:
    """Breadcrumb files of pages below the home page."""
    item = F.struct(F.lit("ListItem").alias("@type"), (F.col("depth") + 1).alias("position"), F.col("name").alias("name"), F.col("item").alias("item"))
    steps = P.breadcrumbs(pages).groupBy("url").agg(F.array_sort(F.collect_list(F.struct("depth", item.alias("i")))).alias("l")).where(F.size("l") > 1)
    body = _object("BreadcrumbList", _itemListElement=F.transform("l", lambda x: x["i"]))
    return steps.select(F.concat(U.slug("url"), F.lit("-breadcrumb.json")).alias("name"), F.col("url").alias("page"), X.json_in_html(body).alias("body"))


def as_snippet(body: Column) -> Column:
    return F.concat(F.lit('<script type="application/ld+json">\n'), body, F.lit("\n</script>"))


def meta_drafts(pages: DataFrame, suffix: str = "") -> DataFrame:
    """url, current and draft title, description and canonical with length verdicts; a draft keeps what is in order and
    marks the rest as to do."""
    named = pages.join(P.labels(pages), "url")
    title = F.when((X.length_verdict("title", C.TITLE_BAND) == "ok"), F.col("title")).when(F.col("label") != "", F.concat("label", F.lit(suffix))).otherwise(F.lit(f"{C.TODO}: title>>"))
    description = F.when(X.length_verdict("meta_description", C.DESCRIPTION_BAND) == "ok", F.col("meta_description")).otherwise(F.lit(f"{C.TODO}: description>>"))
    rows = named.where((F.col("status") == 200) & ~rules.noindex()).select(
        "url", "title", "meta_description", "canonical", title.alias("draft_title"), description.alias("draft_description"), U.normalize(X.falsy("final_url", F.col("url"))).alias("draft_canonical"),
        X.length_verdict("title", C.TITLE_BAND).alias("title_verdict"), X.length_verdict("meta_description", C.DESCRIPTION_BAND).alias("description_verdict"), F.col("source").alias("title_source"))
    return P.draft_duplicates(rows).withColumn("draft_verdict", X.length_verdict("draft_title", C.TITLE_BAND))
