"""Known answers of the column expressions."""
import pytest
from pyspark.sql import functions as F

from sitewright.functions import robots as R
from sitewright.functions import text as X
from sitewright.functions import urls as U


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("url,want", [
    ("HTTP://A.com", "http://a.com/"), ("https://a.com/p?q=1#f", "https://a.com/p?q=1"), ("https://A.com:80/B", "https://a.com:80/B"), ("https://a.com/x y|z", "https://a.com/x y|z")])
def test_normalize(spark, url, want):
    assert one(spark, U.normalize("u"), u=url) == want


@pytest.mark.parametrize("raw,want", [
    ("example.com/a.", "https://example.com/a"), ("<https://Example.com/A#x>", "https://example.com/A"), ("ftp://a.com", None), ("localhost", None), ("10.0.0.1", None),
    ("(https://a.co),", "https://a.co"), ("two words.com", None)])
def test_clean_url(spark, raw, want):
    assert one(spark, U.clean_url("u"), u=raw) == want


def test_domains(spark):
    assert one(spark, U.bare_domain("u"), u="https://WWW.A.com./x") == "a.com"
    assert one(spark, U.is_ours("u", F.lit("www.a.com")), u="https://blog.a.com/") is True
    assert one(spark, U.is_ours("u", F.lit("a.com")), u="https://nota.com/") is False


def test_text(spark):
    assert one(spark, X.collapse("t"), t="  a　 b\n") == "a b"
    assert one(spark, X.script_of("t"), t="한국 text here") == "ko"
    assert one(spark, X.script_of("t"), t="plain") == "en"
    assert [one(spark, X.yes_no("t"), t=t) for t in ("예", " Y ", "없음", "maybe")] == [True, True, False, None]
    assert one(spark, X.split_multi("t"), t="a, b;c|d  e") == list("abcde")
    assert str(one(spark, X.strict_date("t"), t=" 2026-1-2 ")) == "2026-01-02"
    assert one(spark, X.strict_date("t"), t="2026-13-01") is None
    assert one(spark, X.ratio(F.lit(1), F.lit(32))) == 0.0312
    assert one(spark, X.ratio(F.lit(1), F.lit(0))) is None


def test_wilson(spark):
    got = one(spark, X.wilson(F.lit(5), F.lit(10)))
    assert (got["low"], got["high"]) == (0.2366, 0.7634)
    assert one(spark, X.wilson(F.lit(0), F.lit(0))) is None


@pytest.mark.parametrize("raw,ua,want", [
    ("User-agent: *\nDisallow: /", "GPTBot", "star-block"), ("User-agent: gptbot\nDisallow:\n", "GPTBot", "explicit-allow"), ("", "GPTBot", "none"),
    ("User-agent: *\nDisallow: /x", "GPTBot", "star-partial"), ("User-agent: *\nDisallow: /\nAllow: /a", "GPTBot", "star-partial"), ("User-agent: *\nAllow: /\nDisallow: /", "Yeti", "star-allow"),
    ("User-agent: GPTBot-x\nDisallow: /", "GPTBot", "none"), ("User-agent: a\nDisallow: /\nUser-agent: GPTBot\nUser-agent: b\nAllow: /", "GPTBot", "explicit-allow")])
def test_policy(spark, raw, ua, want):
    robots = spark.createDataFrame([("s", raw)], "site string, raw string")
    agents = spark.createDataFrame([("s", ua)], "site string, ua string")
    assert R.policies(R.rules_table(robots), agents).first()["policy"] == want


@pytest.mark.parametrize("rules,path,want", [
    ("Disallow: /a*b$", "/axxb", False), ("Disallow: /a*b$", "/axxbc", True), ("Disallow: /p\nAllow: /p", "/p", True), ("Disallow: /a\nAllow: /ab", "/abc", True),
    ("Disallow: /a?b", "/a?b=1", False), ("Disallow:", "/x", True), ("Disallow: /a.c", "/abc", True)])
def test_allowed(spark, rules, path, want):
    robots = spark.createDataFrame([("s", "User-agent: *\n" + rules)], "site string, raw string")
    asked = spark.createDataFrame([("s", "any", path)], "site string, ua string, target string")
    assert R.allowed(R.rules_table(robots), asked).first()["allowed"] is want


def test_rules_of_another_crawler_bind_nobody_else(spark):
    robots = spark.createDataFrame([("s", "User-agent: GPTBot\nDisallow: /"), ("t", ""), ("v", "User-agent: *\nDisallow: *.pdf$\nAllow: /a*c\nDisallow: /a")], "site string, raw string")
    asked = [("s", "GPTBot", "/x"), ("s", "Yeti", "/x"), ("t", "Yeti", ""), ("v", "Yeti", "/x.pdf"), ("v", "Yeti", "/x.pdf?"), ("v", "Yeti", "/abc"), ("v", "Yeti", "/abd"), ("v", "Yeti", "")]
    rows = spark.createDataFrame([*asked, asked[0]], "site string, ua string, target string")
    got = {(r.site, r.ua, r.target): r.allowed for r in R.allowed(R.rules_table(robots), rows).collect()}
    assert got == dict(zip(asked, [False, True, True, False, True, True, False, True]))


@pytest.mark.parametrize("header,ua,has,lacks", [
    ("noindex", "googlebot", {"noindex"}, set()), ("otherbot: noindex, nofollow", "googlebot", set(), {"noindex", "nofollow"}), ("googlebot: noindex\nnosnippet", "googlebot", {"noindex", "nosnippet"}, set()),
    ("otherbot: noindex\nmax-snippet : 0", "googlebot", {"max-snippet:0"}, {"noindex"}), ("none", "googlebot", {"noindex", "nofollow"}, set()), ("a-bot: noindex, googlebot: nosnippet", "googlebot", {"nosnippet"}, {"noindex"})])
def test_header_scopes(spark, header, ua, has, lacks):
    got = set(one(spark, R.directives(F.lit(""), F.lit(None).cast("string"), "h", ua), h=header))
    assert has <= got and not lacks & got
