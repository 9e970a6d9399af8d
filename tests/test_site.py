"""A small site with planted defects, end to end: crawl, findings, generated files, checks, drift, documents."""
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sitewright.operators import diff, rules
from sitewright.operators import pages as P
from sitewright.operators import verify as V
from sitewright.plans import audit, generate, render
from sitewright.sources import html, sinks, tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the injected fetch runs in the workers
BASE = "https://site.example"


def doc(title, body, head="", h1="Heading"):
    return f'<!doctype html><html lang="en"><head><title>{title}</title>{head}</head><body><h1>{h1}</h1><p>{body}</p></body></html>'


LONG = "words and more words " * 30
SITE = {
    "/": doc("Home of the site", LONG + '<a href="/a">a</a> <a href="b?x=1#y">b</a> <a href="/private/z">z</a> <a href="https://other.example/">o</a> <a href="/pic.png">p</a>', f'<link rel="canonical" href="{BASE}/">'),
    "/a": doc("Same title", LONG + '<a href="/c">c</a>', '<link rel="canonical" href="/a"><meta name="description" content="short">'),
    "/b?x=1": doc("Same title", "thin", '<meta name="robots" content="noindex">'),
    "/c": doc("Only here &amp; now", LONG, '<link rel="canonical" href="/c"><script type="application/ld+json">{"@graph":[{"@type":"Organization","@id":"#o","name":"Only here"}]}</script>'),
    "/private/z": doc("Secret", LONG),
}
ROBOTS = "User-agent: *\nDisallow: /private/\n"


def fetch(url):
    path = url.removeprefix(BASE)
    base = {"final_url": url, "ms": 1, "redirects": 0, "error": None, "headers": {}}
    if path == "/robots.txt":
        return base | {"status": 200, "content_type": "text/plain", "body": ROBOTS}
    if url.startswith(BASE) and path in SITE:
        return base | {"status": 200, "content_type": "text/html", "body": SITE[path]}
    return base | {"status": 404, "content_type": "text/html", "body": "no"}


@pytest.fixture(scope="module")
def crawled(spark):
    return audit.crawl(spark, BASE, fetch)


@pytest.fixture(scope="module")
def analysed(spark, crawled):
    return audit.analyze(crawled.pages, audit.site_row(spark, BASE, crawled, fetch))


def test_crawl(crawled):
    assert sorted(r["url"] for r in crawled.pages.collect()) == [f"{BASE}/", f"{BASE}/a", f"{BASE}/b?x=1", f"{BASE}/c"]
    c = crawled.coverage.first()
    assert c["complete"] and c["reasons"] == []


def test_crawl_limit(spark):
    c = audit.crawl(spark, BASE, fetch, max_pages=2)
    assert c.pages.count() == 2
    assert "max_pages_reached" in c.coverage.first()["reasons"]


def test_findings(analysed):
    found = {r["code"]: r for r in analysed[0].collect()}
    assert {"NOINDEX", "TITLE_DUPLICATE", "THIN_TEXT", "DESC_MISSING", "DESC_TOO_SHORT", "CANONICAL_MISSING", "JSONLD_MISSING", "SITEMAP_MISSING", "SITEMAP_NOT_DECLARED", "FAQ_MISSING", "LLMS_TXT_MISSING", "NAVER_VERIFY_MISSING", "AI_CRAWLER_PARTIAL"} <= set(found)
    assert not {"ROBOTS_MISSING", "HTTP_ERROR", "SOFT_404", "H1_MISSING", "ORG_JSONLD_MISSING", "CANONICAL_NOT_SELF", "CRAWL_INCOMPLETE"} & set(found)
    assert found["NOINDEX"]["urls"] == [f"{BASE}/b?x=1"] and found["TITLE_DUPLICATE"]["count"] == 2 and found["THIN_TEXT"]["severity"] == "warn"
    board = {r["lane"]: r["status"] for r in analysed[2].collect()}
    assert board["SEO"] == "bad" and board["AEO"] == "ok" and board["reputation"] == "na"
    stats = analysed[1].first()
    assert (stats["pages_crawled"], stats["unique_titles"], stats["pages_with_jsonld"], stats["pages_noindex"]) == (4, 3, 1, 1)


def test_no_pages(spark):
    empty = html.page_records(spark.createDataFrame([], "url string, status int, final_url string, content_type string, headers map<string,string>, body string, ms int, redirects int, error string")).withColumn("pos", F.lit(0).cast("long"))
    codes = {r["code"] for r in rules.page_findings(empty).collect()}
    assert codes == {"FAQ_MISSING", "ORG_JSONLD_MISSING", "NAVER_VERIFY_MISSING"}


def test_page_findings_against_plain_counts(spark):
    """Duplicates with a title that most pages share, null and failed statuses, repeated rows, ties in the order."""
    names = "url status title meta_description jsonld_types pos".split()
    rows = [(f"https://a.example/{i % 170}", (200, 404, None, 200, 200)[i % 5], ("same", f"t{i // 3}", "", None)[min(i % 6, 3)] if i % 6 > 2 else "same", f"d{i % 60}", ["Organization"] if i % 50 == 0 else [], i // 2) for i in range(200)]
    pages = spark.createDataFrame(rows, "url string, status int, title string, meta_description string, jsonld_types array<string>, pos long")
    pages = pages.withColumns({c: F.lit(None).cast("string") for c in ("meta_robots", "meta_googlebot", "x_robots_tag", "canonical")} | {
        "intended_indexable": F.lit(True), "h1": F.array(F.lit("h")), "jsonld_count": F.lit(1), "text_chars": F.lit(500), "naver_site_verification": F.lit(True), "final_url": F.col("url")})
    found = {r["code"]: r for r in rules.page_findings(pages).collect()}
    plain = [dict(zip(names, r)) for r in rows]
    ok = [r for r in plain if r["status"] == 200]

    def check(code, hits):
        first = [r["url"] for r in sorted(hits, key=lambda r: (r["pos"], r["url"]))[:20]]
        assert (found[code]["count"], found[code]["urls"]) == (len(hits), first), code

    for code, c in (("TITLE_DUPLICATE", "title"), ("DESC_DUPLICATE", "meta_description")):
        values = [r[c] for r in ok]
        check(code, [r for r in ok if r[c] and values.count(r[c]) > 1])
    check("HTTP_ERROR", [r for r in plain if r["status"] is None or r["status"] >= 400])
    check("TITLE_MISSING", [r for r in ok if not r["title"]])
    check("ORG_JSONLD_SCATTERED", [r for r in ok if r["jsonld_types"]])
    assert found["FAQ_MISSING"]["count"] == 0 and found["FAQ_MISSING"]["urls"] == [] and not {"NAVER_VERIFY_MISSING", "ORG_JSONLD_MISSING", "JSONLD_MISSING"} & set(found)


def test_parser():
    p = html.parse_page('<html lang=""><html lang="ko"><title> a\n b</title><meta property="og:title" content="x"><meta name=robots content=noindex><meta name=ROBOTS content=nofollow><h1></h1><script>var t="</p>";</script><noscript>n</noscript><p>seen &amp; read')
    assert (p["lang"], p["title"], p["meta_robots"], p["h1"], p["text"]) == ("ko", "a b", "noindex, nofollow", [""], "a bseen & read")
    assert p["og"] == {"title": "x"} and p["jsonld_count"] == 0
    assert html.parse_page(None)["text_chars"] == 0


def test_sitemap_xml():
    assert html.sitemap_content('<x:urlset xmlns:x="n"><x:url><x:loc> a </x:loc></x:url></x:urlset>')["locs"] == ["a"]
    assert html.sitemap_content("<urlset><url>")["parsed"] is False
    assert html.sitemap_content("<html/>")["parsed"] is False


def test_bodies():
    import gzip

    assert html.bounded_gunzip(gzip.compress(b"x" * 100), 10) == (b"x" * 10, "body_truncated")
    assert html.bounded_gunzip(b"no")[1] == "invalid_gzip"
    assert html.decode_body("é".encode("latin-1"), "text/html; charset=ISO-8859-1") == "é"
    assert html.decode_body(b"\xff", "text/html; charset=nonsense") == "�"


def test_sitemap_and_drafts(spark, crawled, tmp_path):
    urls = [r["url"] for r in P.eligible(crawled.pages, "site.example").orderBy("url").collect()]
    assert urls == [f"{BASE}/"] or f"{BASE}/c" in urls
    path = f"{tmp_path}/sitemaps"
    assert generate.sitemap_files(P.eligible(crawled.pages, "site.example"), path, BASE) == ["sitemap.xml"]
    assert html.sitemap_content((tmp_path / "sitemaps" / "sitemap.xml").read_text())["locs"] == urls
    drafts = {r["url"]: r for r in generate.meta_drafts(crawled.pages).collect()}
    assert f"{BASE}/b?x=1" not in drafts and drafts[f"{BASE}/c"]["draft_description"].startswith("<<TODO")


def test_robots_merge():
    text, diff_ = generate.merged_robots(ROBOTS, [("GPTBot", "copy"), ("Yeti", "declare"), ("Bingbot", "keep")], [("/private/", False)], [f"{BASE}/sitemap.xml"])
    assert text.startswith(ROBOTS) and "User-agent: GPTBot\nDisallow: /private/\n" in text and "User-agent: Yeti\nAllow: /\n" in text
    assert "Bingbot" not in text and text.rstrip().endswith("Sitemap: https://site.example/sitemap.xml") and diff_.startswith("---")


def test_json_ld_files(spark, crawled):
    facts = spark.createDataFrame([("Q <1>?", "A", f"{BASE}/c"), ("Q2", "A2", f"{BASE}/none"), ("", "A", f"{BASE}/c")], "q string, a string, page_url string")
    files, left = generate.faqs(facts, crawled.pages)
    body = files.first()["body"]
    assert "\\u003c1\\u003e" in body and json.loads(body)["mainEntity"][0]["acceptedAnswer"]["text"] == "A"
    assert {r["reason"] for r in left.collect()} == {"page_not_seen", "empty"}
    goods = spark.createDataFrame([(f"{BASE}/c", "P", None, "10", None)], "page_url string, name string, description string, price string, currency string")
    product = json.loads(generate.products(goods, crawled.pages).first()["body"])
    assert product["name"] == "P" and "offers" not in product and "description" not in product


def test_verify(spark, crawled):
    live = crawled.pages
    none = spark.createDataFrame([], "url string")
    row = V.noindex_check(spark.createDataFrame([(f"{BASE}/b?x=1",), (f"{BASE}/a",), (f"{BASE}/gone",)], "url string"), live, none).first()
    assert row["status"] == "fail" and row["evidence"]["urls"] == f"{BASE}/b?x=1" and row["evidence"]["unverified"] == "1"
    robots = crawled.robots
    checks = {r["id"]: r["status"] for r in V.robots_checks(robots, spark.createDataFrame([(ROBOTS + "Disallow: /q\n",)], "raw string"), spark.createDataFrame([(ROBOTS,)], "raw string")).collect()}
    assert checks == {"robots.status": "pass", "robots.preserved": "fail", "robots.policy": "pass", "robots.sitemap": "fail"}
    locs = spark.createDataFrame([(f"{BASE}/", 0), (f"{BASE}/b?x=1", 1), (f"{BASE}/new", 2), ("https://off.example/", 3)], "url string, pos int")
    coverage = spark.createDataFrame([(1, 1, 0)], "files int, reachable int, remaining int")
    got = V.sitemap_checks(locs, live, "site.example", coverage)
    assert {r["id"]: r["status"] for r in got.collect()} == {"sitemap.reachable": "pass", "sitemap.host": "warn", "sitemap.locs": "warn", "sitemap.noindex": "fail", "sitemap.canonical": "warn"}
    assert V.exit_code(got) == 1 and V.exit_code(got.where("status <> 'fail'")) == 2
    drafts = spark.createDataFrame([(f"{BASE}/a", "Same  title", "<<TODO: x>>", None), (f"{BASE}/c", "Other", None, None)], "url string, draft_title string, draft_description string, draft_canonical string")
    assert {r["id"]: r["status"] for r in V.meta_checks(drafts, live).collect()} == {"meta.applied": "fail", "meta.duplicate": "fail"}


def test_json_ld_checks(spark, crawled):
    package = html.ld_table(spark.createDataFrame([("o.json", ['{"@type":"Organization","@id":"#o","name":"Only here"}']), ("x.json", ['{"@type":"Product","name":"Unseen"}'])], "url string, ld array<string>"))
    targets = spark.createDataFrame([("o.json", f"{BASE}/c"), ("x.json", f"{BASE}/c")], "name string, url string")
    got = {r["id"]: r["status"] for r in V.jsonld_checks(package, targets, crawled.pages, True).collect()}
    assert got == {"jsonld.present": "fail", "jsonld.mapping": "pass", "jsonld.type": "fail", "jsonld.visible": "fail", "jsonld.org_id": "pass"}
    alone = {r["id"]: r["status"] for r in V.jsonld_checks(package.where("url = 'o.json'"), targets, crawled.pages, True).collect()}
    assert alone["jsonld.present"] == "pass" and alone["jsonld.visible"] == "pass"


def test_diff(spark, analysed, crawled):
    findings, stats, board = analysed
    tables_ = {"findings": findings.withColumn("pos", F.lit(0)), "stats": stats.unpivot([], stats.columns, "key", "value"), "pages": crawled.pages, "scorecard": board}
    later = tables_ | {"findings": tables_["findings"].where("code <> 'NOINDEX'"), "pages": crawled.pages.where("url not like '%/c'")}
    got = {r["id"]: r for r in V.diff_checks(tables_, later).collect()}
    assert got["diff.resolved"]["evidence"]["codes"] == "NOINDEX" and got["diff.new"]["status"] == "pass" and got["diff.pages"]["evidence"]["urls"] == f"{BASE}/c"
    worse = {r["id"]: r["status"] for r in V.diff_checks(later, tables_).collect()}
    assert worse["diff.new"] == "fail"


def test_documents(spark, analysed, tmp_path):
    text = render.page("T <x>", {"Findings": analysed[0].select("code", "count")})
    assert "T &lt;x&gt;" in text and "NOINDEX" in text
    assert "| code |" in render.markdown("T", {"F": analysed[0].select("code")})
    sinks.write_json(tmp_path / "a" / "x.json", {"k": "é"})
    assert json.loads((tmp_path / "a" / "x.json").read_text()) == {"k": "é"}
    sinks.form_csv([{"date": "2026-01-01", "query_id": "Q1", "extra": 1}], tmp_path / "f.csv")
    form = tables.read_form(spark, str(tmp_path / "f.csv")).first()
    assert (form["date"], form["query_id"], form["cited"]) == ("2026-01-01", "Q1", None)
    (tmp_path / "jsonld").mkdir()
    (tmp_path / "jsonld" / "old.json").write_text("{}")
    assert sinks.collect_garbage(["jsonld/old.json", "../evil"], [], {"jsonld"}, tmp_path) == ["jsonld/old.json"]


def test_comparable(spark):
    shape = "cohorts array<string>, fingerprint string, errors int, unmeasured int, incompatible_rows int, regression_eligible boolean, cumulative boolean"
    good = spark.createDataFrame([(["c"], "f", 0, 0, 0, True, False)], shape)
    bad = spark.createDataFrame([(["d"], "f", 1, 0, 0, True, True)], shape)
    assert diff.comparable(good, good).first()["comparable"]
    assert diff.comparable(good, bad).first()["reasons"] == ["conditions_differ", "errors", "cumulative"]


def test_answers(spark):
    body = json.dumps({"output": [{"content": [{"text": "hi", "annotations": [{"type": "url_citation", "url": "https://a/"}, {"type": "other", "url": "https://b/"}]}]}]})
    row = tables.parse_answer(spark.createDataFrame([(1, body)], "id int, body string"), "openai").first()
    assert (row["cited_urls"], row["text"], row["error"]) == (["https://a/"], "hi", None)
    body = json.dumps({"content": [{"type": "text", "text": "yo", "citations": [{"url": "https://c/"}]}, {"type": "text", "text": "!"}]})
    row = tables.parse_answer(spark.createDataFrame([(1, body)], "id int, body string"), "anthropic").first()
    assert (row["cited_urls"], row["text"]) == (["https://c/"], "yo!")


def test_identity_of_json_ld_objects():
    same = lambda a, b: html.identity(a) == html.identity(b)
    org = {"@type": "Organization", "@id": "https://s.example/#a", "name": "S", "url": "https://S.example"}
    assert not same(org, {**org, "@id": "https://s.example/#b"})
    assert not same(org, {**org, "@id": "https://s.example/"})
    assert same(org, {**org, "@id": "HTTPS://S.example#a", "url": "https://s.example/#top"})
    assert same(org, {**org, "@type": ["Organization", "LocalBusiness"], "logo": "x"})
    assert not same(org, {**org, "@type": ["LocalBusiness", "Organization"]})
    faq = {"@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "a", "acceptedAnswer": {"text": "1"}}, {"name": " b ", "acceptedAnswer": {"text": "2"}}]}
    assert same(faq, {**faq, "mainEntity": faq["mainEntity"][::-1]})
    assert not same(faq, {**faq, "mainEntity": faq["mainEntity"][:1]})
    other = {"@type": "Event", "name": "x"}
    assert same(other, dict(reversed(other.items()))) and not same(other, {**other, "place": "y"})
    assert same({}, {}) and not same({}, {"name": "x"})


def greedy(sizes, most, most_bytes):
    out, chunk, n, used = [], 0, 0, 0
    for size in sizes:
        if n and (n >= most or used + size > most_bytes):
            chunk, n, used = chunk + 1, 0, 0
        out.append(chunk)
        n, used = n + 1, used + size
    return out


@pytest.mark.parametrize("n,most,most_bytes,block", [(0, 5, 100, 8), (300, 7, 400, 8), (64, 8, 500, 8), (130, 9, 60, 16), (130, 100, 2000, 1)])
def test_greedy_chunks(spark, n, most, most_bytes, block):
    import random

    rng = random.Random(n)
    urls = sorted({f"https://s.example/{k:04d}{'é' * rng.choice([0, 1, 3, 40])}" for k in range(n)}, key=str.encode)
    rows = spark.createDataFrame([(u,) for u in [*urls, None]], "url string")
    got = P.sitemap_chunks(rows, most, most_bytes, extra=10, block=block).orderBy("chunk", "url").collect()
    assert [(r.url, r.chunk) for r in got] == list(zip(urls, greedy([len(u.encode()) + 10 for u in urls], most, most_bytes)))


def test_sitemap_parts_and_index(spark, tmp_path):
    rows = spark.createDataFrame([(f"https://s.example/{k}?a&b",) for k in range(5)], "url string")
    path = str(tmp_path / "s")
    names = generate.sitemap_files(rows, path, "https://s.example", most=2)
    assert names == ["sitemap_index.xml", "sitemap-1.xml", "sitemap-2.xml", "sitemap-3.xml"]
    assert html.sitemap_content((tmp_path / "s" / "sitemap_index.xml").read_text())["locs"] == [f"https://s.example/{n}" for n in names[1:]]
    assert html.sitemap_content((tmp_path / "s" / "sitemap-3.xml").read_text())["locs"] == ["https://s.example/4?a&b"]
    assert generate.sitemap_files(rows.limit(0), str(tmp_path / "none"), "https://s.example") == ["sitemap.xml"]


@pytest.mark.parametrize("most", [None, 1, 7, 25])
def test_reach_in_the_order_of_a_queue(spark, most):
    import random

    rng = random.Random(3)
    links = {f"n{k}": [f"n{rng.randrange(60)}" for _ in range(rng.choice([0, 1, 2, 4]))] for k in range(60)}
    seeds = ["n5", "n1"]
    queue, depth = list(seeds), dict.fromkeys(seeds, 0)
    for page in queue:
        for link in links[page]:
            if link not in depth:
                depth[link] = depth[page] + 1
                queue.append(link)
    edges = spark.createDataFrame([(s, d, k) for s, named in links.items() for k, d in enumerate(named)], "src string, dst string, pos int")
    got = P.reach(edges, spark.createDataFrame(list(zip(seeds, range(2))), "url string, pos int"), most).orderBy("rank").collect()
    assert [(r.url, r.depth, r["rank"]) for r in got] == [(u, depth[u], k) for k, u in enumerate(queue[:most])]
    assert not P.reach(edges, spark.createDataFrame([], "url string, pos int")).count() and not [t for t in spark.catalog.listTables() if t.name.startswith(("links_", "found_"))]


def test_sitemap_entries_under_their_own_file(spark, tmp_path):
    """Several files to a task: what Python parses keeps the name of its file."""
    from sitewright.plans import queries as Q

    urls = [f"https://s.example/{k:03d}" for k in range(330)]
    spark.createDataFrame([(k, u, "") for k, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.file, r.kind, r.url) for r in Q.sitemap_files(spark, str(tmp_path)).collect())
    chunks = greedy([len(u) + 40 for u in urls], 40, 3000)
    want = [(f"sitemap-{c + 1}.xml", "urlset", u) for c, u in zip(chunks, urls)]
    want += [("sitemap_index.xml", "sitemapindex", f"https://s.example/a&b/sitemap-{c + 1}.xml") for c in sorted(set(chunks))]
    assert chunks[-1] > 7 and got == sorted(want)


def test_breadcrumbs_of_a_repeated_url(spark, tmp_path):
    """Rows of one URL: its steps once, in the query for each row, and once in its file."""
    from sitewright.plans import queries as Q

    home, deep = "https://s.example/", "https://s.example/a/b"
    html_of = "<title>{}</title>".format
    spark.createDataFrame([(k, u, html_of("t")) for k, u in enumerate([home, deep, deep, deep, home, None])], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.depth) for r in Q.breadcrumb_depths(spark, str(tmp_path)).collect())
    assert got == [(0, 0), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (3, 2), (4, 0)]
    pages = spark.createDataFrame([(u, [], t) for u, t in ((home, "Home"), (deep, "Deep"), (deep, "Deep"))], "url string, h1 array<string>, title string")
    files = generate.breadcrumb_files(pages).collect()
    assert [[(i["position"], i["name"]) for i in json.loads(r.body)["itemListElement"]] for r in files] == [[(1, "Home"), (2, "a"), (3, "Deep")]]
