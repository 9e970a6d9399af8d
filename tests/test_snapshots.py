"""The store of snapshots: whole writes, refusals, failures on the way, hashes, two writers."""
import pytest

from sitewright.sources import scratch, snapshots

ROWS = "kind string, date string, host string, schema string, n long"


def rows(spark, *given, host="S.example"):
    return spark.createDataFrame([(k, d, host, f"x/{k}/1", n) for k, d, n in given], ROWS)


def stored(spark, path, **which):
    return sorted((r.kind, r.date, r.n) for r in snapshots.read(spark, path, ROWS, **which).collect())


def test_store(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "history")
    assert stored(spark, path) == [] and snapshots.write(rows(spark), path, "s.example")["version"] == 0
    first = [("audit", "2026-01-01", 1), ("audit", "2026-01-01", 1), ("measure", "2026-01-02", None)]
    index = snapshots.write(rows(spark, *first), path, "s.example", label="one")
    assert (index["version"], index["baseline_date"], index["next_due"], index["snapshots"][0]["rows"]) == (1, "2026-01-01", "2026-01-16", 2)
    before = snapshots.read_index(spark, path)

    with pytest.raises(FileExistsError):  # one clash keeps the others out as well
        snapshots.write(rows(spark, ("audit", "2026-01-01", 9), ("verify", "2026-01-03", 9)), path, "s.example")
    for bad in (rows(spark, ("audit", "2026-02-30", 1)), rows(spark, ("else", "2026-02-01", 1)), rows(spark, ("audit", "2026-02-01", 1), host="t.example")):
        with pytest.raises(ValueError):
            snapshots.write(bad, path, "s.example")
    with pytest.raises(ValueError):
        snapshots.write(rows(spark, ("audit", "2026-02-01", 1), host="t.example"), path, "t.example")
    folders = scratch.names(spark, f"{path}/data")

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_commit", fails)
        with pytest.raises(OSError):
            snapshots.write(rows(spark, ("audit", "2026-01-01", 9)), path, "s.example", force=True)
    assert snapshots.read_index(spark, path) == before and scratch.names(spark, f"{path}/data") == folders
    assert stored(spark, path, kind="audit") == first[:2]

    index = snapshots.write(rows(spark, ("audit", "2026-01-01", 9), ("audit", "2026-01-05", 5)), path, "s.example", force=True, baseline=True)
    assert index["baseline_date"] == "2026-01-05" and [s["date"] for s in index["snapshots"]] == ["2026-01-01", "2026-01-02", "2026-01-05"]
    assert stored(spark, path, date="2026-01-01") == [("audit", "2026-01-01", 9)] and len(stored(spark, path)) == 3
    assert not snapshots.damaged(spark, path, ROWS).count()

    with pytest.raises(FileExistsError):  # another writer was first
        snapshots._commit(spark, path, index)
    assert len([n for n in scratch.names(spark, path) if n.startswith("index-")]) == 2
    file = next(s["file"] for s in index["snapshots"] if s["kind"] == "measure")
    rows(spark, ("measure", "2026-01-02", 7)).drop("kind", "date").write.mode("overwrite").parquet(f"{path}/{file}")
    assert [tuple(r) for r in snapshots.damaged(spark, path, ROWS).collect()] == [("measure", "2026-01-02")]


def test_digest_is_of_rows_not_of_their_order(spark):
    one = [("audit", "2026-01-01", k % 3) for k in range(9)]
    digest = lambda given: snapshots.digests(rows(spark, *given)).first()["sha256"]
    assert digest(one) == digest(one[::-1]) and digest(one) != digest(one[:-1] + [("audit", "2026-01-01", 3)])
