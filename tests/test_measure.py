"""Reports of two periods, the drift between them, and the small helpers."""
import json

from pyspark.sql import functions as F

from sitewright.operators import diff, measure, rules
from sitewright.plans import measure as plan
from sitewright.plans import render
from sitewright.sources import sinks, standins
from tests.test_log import ROW, write
from sitewright.sources import tables


def period(spark, path, date, hits, runs=6, engine="chatgpt"):
    write(path, [ROW | {"date": date, "query_id": f"Q{q}", "run_no": n, "engine": engine, "cited": n <= hits, "cited_urls": ["https://me.com/a"], "competitor_domains": ["c.com"]} for q in (1, 5) for n in range(1, runs + 1)])
    return plan.tables(measure.last_wins(tables.read_log(spark, str(path)), "file", "line"), standins.queries(spark), "me.com")


def test_report_and_drift(spark, tmp_path):
    before, after = period(spark, tmp_path / "a", "2026-01-01", 1), period(spark, tmp_path / "b", "2026-02-01", 5)
    doc = plan.document(before, "me.com", False)
    json.dumps(doc, default=str)
    assert doc["quality"]["regression_eligible"] and len(doc["queries"]) == 10 and doc["ours"] == [{"url": "https://me.com/a", "n": 12}]
    got = plan.drift(before, after)
    assert got["comparable"].first()["comparable"]
    assert {r["type"]: r["verdict"] for r in got["rates"].collect()} == {"brand": "improvement", "nonbrand": "improvement"}
    assert got["engines"].first()["points"] == 66.7
    few = period(spark, tmp_path / "c", "2026-02-01", 2, runs=2)
    assert {r["verdict"] for r in plan.drift(before, few)["rates"].collect()} == {"inconclusive"}
    other = period(spark, tmp_path / "d", "2026-02-01", 5, engine="gemini")
    assert plan.drift(before, other)["comparable"].first()["reasons"] == ["conditions_differ"]


def test_latest_and_cumulative(spark, tmp_path):
    write(tmp_path / "l", [ROW | {"date": "2026-01-01", "cited": False}, ROW | {"date": "2026-01-02", "cited": True}])
    log = measure.last_wins(tables.read_log(spark, str(tmp_path / "l")), "file", "line")
    rate = lambda c: [r["rate"] for r in plan.tables(log, standins.queries(spark), "me.com", cumulative=c)["totals"].collect() if r["type"] == "brand"]
    assert rate(False) == [1.0] and rate(True) == [0.5]


def test_helpers(spark, tmp_path):
    days = spark.createDataFrame([("2026-01-01", 0.25, 8), ("2026-01-15", 0.5, 40)], "date string, rate double, runs int")
    h = measure.headline(days, 4, 2).first()
    assert (h["points"], h["runs_per_query"], h["next_date"]) == (25.0, 5, "2026-01-29")
    s = spark.createDataFrame([("2026-01-01", "https://chatgpt.com/"), ("2026-01-01", "google.com")], "date string, source string")
    assert measure.ai_referrals(s).first()["sessions"] == 1
    assert measure.settled(s, "2026-01-04").count() == 0 and measure.settled(s, "2026-01-05").count() == 2
    f = spark.createDataFrame([("TITLE_DUPLICATE", "warn", 4), ("NOINDEX", "critical", 1)], "code string, severity string, count long")
    assert rules.severity_counts(f).first().asDict() == {"critical": 1, "warn": 1, "info": 0}
    a = spark.createDataFrame([("dup_titles", 2), ("sitemap_urls", 100)], "metric string, value long")
    b = spark.createDataFrame([("dup_titles", 4), ("sitemap_urls", 81)], "metric string, value long")
    assert {r["metric"]: r["verdict"] for r in diff.metric_diff(a, b).collect()} == {"dup_titles": "regression", "sitemap_urls": "flat"}
    assert render.annotate("A robots <tag> robots txt", {"robots": "r", "robots txt": "rt"}) == 'A <abbr title="r">robots</abbr> &lt;tag&gt; <abbr title="rt">robots txt</abbr>'
    assert sinks.init_queries(tmp_path / "q.json") and not sinks.init_queries(tmp_path / "q.json")
    assert tables.read_query_set(spark, str(tmp_path / "q.json")).count() == 4
    assert sinks.archive(tmp_path / "q.json", tmp_path / "old", "1").name == "q-1.json" and sinks.archive(tmp_path / "none", tmp_path, "1") is None
    snaps = spark.createDataFrame([("audit", "2026-01-01", "a", "", ""), ("measure", "2026-01-05", "m", "", "first")], "kind string, date string, file string, sha256 string, label string")
    assert diff.next_due(snaps).first()["next_due"] == "2026-01-19"
    assert diff.next_due(snaps.where(F.col("kind") == "audit")).first()["next_due"] == "2026-01-15"
