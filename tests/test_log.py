"""The observation log: reading, corrections, streams."""
import json

from pyspark.sql import functions as F

from sitewright.operators import measure as M
from sitewright.sources import tables
from sitewright.streaming import log as stream

ROW = {"schema": "ns/measure-row/2", "date": "2026-01-01", "query_id": "Q1", "engine": "chatgpt", "run_no": 1, "outcome": "observed", "cited": True, "recorded_at": "2026-01-01T10:00:00Z"}


def write(path, rows):
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{len(list(path.iterdir()))}.json").write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))


def test_read(spark, tmp_path):
    write(tmp_path / "l", [ROW, "", "{broken", "[1]", ROW | {"engine": "nobody"}, ROW | {"schema": "x"}, ROW | {"outcome": "odd"}, {k: v for k, v in ROW.items() if k != "outcome"} | {"schema": "measure-row/1", "run_no": 2}, ROW | {"date": None}])
    assert tables.read_log(spark, str(tmp_path / "l")).count() == 2


def test_errors_are_no_negatives(spark, tmp_path):
    write(tmp_path / "l", [ROW, ROW | {"run_no": 2, "outcome": "error", "cited": None, "error": "timeout"}])
    rows = tables.read_log(spark, str(tmp_path / "l")).withColumns({"type": F.lit("brand"), "compatible": F.lit(True)})
    s = M.slots(rows).where("type = 'brand'").first()
    assert (s["attempts"], s["runs"], s["cited"], s["errors"], s["rate"]) == (2, 1, 1, 1, 1.0)
    assert not M.quality(rows).first()["regression_eligible"]
    empty = M.slots(rows).where("type = 'nonbrand'").first()
    assert empty["attempts"] == 0 and empty["rate"] is None


def test_last_date_beside_all_dates(spark):
    rows = [("2026-01-01", "observed", True), ("2026-01-01", "error", None), ("2026-01-02", "observed", False), ("2026-01-02", "observed", True)]
    log = spark.createDataFrame(rows, "date string, outcome string, cited boolean").withColumn("brand_mentioned", F.lit(False))
    got = {r["scope"]: (r["runs"], r["cited"], r["rate"]) for r in M.scopes(log).collect()}
    assert got == {"latest": (2, 1, 0.5), "cumulative": (3, 2, 0.6667)}
    assert M.scopes(log.limit(0)).count() == 0


def test_question_set(spark):
    raw = spark.createDataFrame([(0, "a", "", "brand", None), (1, "a", "later", "brand", None), (2, "b", "text", "odd", None), (3, "c", "text", "nonbrand", "n"), (4, " ", "x", "brand", None)], "pos int, id string, text string, type string, note string")
    assert [r["id"] for r in tables.query_set(raw).collect()] == ["c"]


def test_competitors(spark):
    row = spark.createDataFrame([("a.com, www.b.com", ["https://c.com/x", "https://me.com/"])], "d string, u array<string>")
    assert row.select(M.named_competitors("d", F.col("u"), "me.com").alias("x")).first()["x"] == ["a.com", "b.com", "c.com"]


def test_stream_keeps_the_last(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    write(source, [ROW, ROW | {"run_no": 2}])
    stream.keep_latest(stream.read(spark, str(source)), target, str(tmp_path / "c")).awaitTermination()
    write(source, [ROW | {"cited": False, "recorded_at": "2026-01-02T10:00:00Z"}, ROW | {"date": "2026-01-03"}])
    stream.keep_latest(stream.read(spark, str(source)), target, str(tmp_path / "c")).awaitTermination()
    got = {(str(r["date"]), r["run_no"]): r["cited"] for r in spark.read.parquet(target).collect()}
    assert got == {("2026-01-01", 1): False, ("2026-01-01", 2): True, ("2026-01-03", 1): True}


def test_daily_counts(spark, tmp_path):
    source = tmp_path / "in"
    write(source, [ROW, ROW | {"run_no": 2, "cited": False}])
    query = stream.daily_counts(stream.read(spark, str(source))).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    row = spark.table("daily").first()
    assert (row["attempts"], row["runs"], row["cited"]) == (2, 2, 1)


def test_last_line_wins_however_splits_are_cut(spark, tmp_path):
    import random

    rng, last = random.Random(5), {}
    (tmp_path / "l").mkdir()
    for file in range(3):
        with open(tmp_path / "l" / f"log-{file}.jsonl", "w") as out:
            for k in range(200):
                row = {"schema": "sitewright/measure-row/2", "date": "2026-01-01", "query_id": f"q{rng.randrange(40)}", "engine": "gemini", "run_no": 1, "outcome": "observed", "note": f"{file}:{k}" + "x" * rng.randrange(90)}
                last[row["query_id"]] = row["note"]
                out.write(json.dumps(row) + "\n")
    options = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    try:
        for name, value in options.items():
            spark.conf.set(name, value)
        log = tables.read_log(spark, str(tmp_path / "l"))
        assert log.select("file", "line.block").distinct().count() > 20
        got = M.last_wins(log, "file", "line").collect()
    finally:
        for name in options:
            spark.conf.unset(name)
    assert {r.query_id: r.note for r in got} == last
