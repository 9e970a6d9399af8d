"""Files that a run owns, meta drafts, the index of snapshots, and the orders in which rows are shown."""
import json

import pytest

from sitewright.operators import messages
from sitewright.sources import sinks

SNAPSHOT = "kind string, date string, file string, sha256 string, label string"


def test_meta_drafts_are_read_back(spark, tmp_path):
    rows = [("https://a.example/", 'A "quoted", title', None), ("https://a.example/b", "line\nbreak", "d")]
    drafts = spark.createDataFrame(rows, "url string, draft_title string, draft_description string")
    sinks.write_meta(drafts, str(tmp_path))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/meta-draft.csv")
    assert back.columns == drafts.columns and sorted(back.collect()) == sorted(drafts.collect())
    again = spark.read.schema(drafts.schema).json(f"{tmp_path}/meta-draft.json")
    assert sorted(map(str, again.collect())) == sorted(map(str, drafts.collect()))
    sinks.write_meta(drafts.limit(0), str(tmp_path))
    assert spark.read.schema(drafts.schema).json(f"{tmp_path}/meta-draft.json").count() == 0


def test_manifest_owns_only_what_a_run_made(tmp_path):
    for name in ("jsonld/a.json", "jsonld/b.json", "robots.txt", "mine.txt"):
        sinks.write_bytes(tmp_path / name, b"x")
    assert sinks.finish_files(["jsonld/a.json", "jsonld/b.json", "robots.txt"], {"jsonld", "robots"}, tmp_path) == []
    assert sinks.finish_files(["jsonld/b.json"], {"jsonld"}, tmp_path) == ["jsonld/a.json"]
    assert sinks.read_manifest(tmp_path) == ["jsonld/b.json", "robots.txt"] and (tmp_path / "mine.txt").exists()
    for name in ("sitemap-1.xml", "sitemap-2.xml"):
        sinks.write_bytes(tmp_path / name, b"x")
    sinks.finish_files(["sitemap-1.xml", "sitemap-2.xml"], {"sitemap"}, tmp_path)
    assert sinks.finish_files(["sitemap.xml"], {"sitemap"}, tmp_path) == ["sitemap-1.xml", "sitemap-2.xml"]
    (tmp_path / sinks.MANIFEST).write_text("[]")
    assert sinks.read_manifest(tmp_path) == []


def test_snapshots_with_faults_are_named(spark):
    rows = [("audit", "2026-01-02", "A.example", "x/audit/1"), ("other", "2026-13-01", "a.example", "x/audit/1"), ("verify", None, None, None)]
    got = sinks.snapshot_faults(spark.createDataFrame(rows, "kind string, date string, host string, schema string"), "a.example").collect()
    assert sorted((r.kind, r.fault) for r in got) == [("other", "date"), ("other", "kind"), ("other", "schema"), ("verify", "date"), ("verify", "host"), ("verify", "schema")]


def test_index_is_made_anew_and_refuses_another_site(spark, tmp_path):
    path = tmp_path / "history" / "index.json"
    assert sinks.read_index(path, "a.example")["snapshots"] == []
    rows = [("verify", "2026-01-02", "v", "3", None), ("audit", "2026-01-02", "a", "1", "first"), ("measure", "2026-01-01", "m", "2", None)]
    made = sinks.write_index(spark.createDataFrame(rows, SNAPSHOT), path, "a.example")
    assert [s["file"] for s in made["snapshots"]] == ["m", "a", "v"] and made["baseline_date"] == "2026-01-01" and made["next_due"] == "2026-01-15"
    assert sinks.read_index(path, "A.EXAMPLE") == made
    with pytest.raises(ValueError):
        sinks.read_index(path, "b.example")
    path.write_text(json.dumps({"schema": "else"}))
    with pytest.raises(ValueError):
        sinks.read_index(path)


def test_orders(spark):
    checks = spark.createDataFrame([("a", "pass", 0), ("b", "fail", 1), ("c", "odd", 2), ("d", "fail", 0)], "id string, status string, pos int")
    assert [r.id for r in messages.checks_in_order(checks).collect()] == ["d", "b", "a", "c"]
    log = spark.createDataFrame([("2026-01-02", "q1", "b", 1), ("2026-01-01", "q2", "a", 2), ("2026-01-01", "q2", "a", 1)], "date string, query_id string, engine string, run_no int")
    assert [r.run_no for r in messages.log_in_order(log).collect()] == [1, 2, 1]
