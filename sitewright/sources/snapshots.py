"""A store of dated snapshots that changes as a whole or not at all.

Rows (kind, date, host, schema and whatever a kind holds) are judged, written aside and read again before an index that names
them takes effect; stored files are never touched again.  Each index is a file of its own number, made aside and named only if
nobody took that number meanwhile, so of two writers at once one fails.  Readers go by the index of the greatest number: what a
failed write left behind is in none, and old bytes stay where an index has them.  The index holds one row a run, never rows."""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, messages
from . import scratch, sinks

ENTRY = "kind string, date string, file string, sha256 string, label string, rows bigint"


def digests(rows: DataFrame) -> DataFrame:
    """kind, date, rows, sha256 of what each snapshot holds, whatever the order of its rows: the hashes of rows are added up in
    four parts, so that no snapshot meets in one task, and the sums are hashed."""
    one = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(one, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)") for k in range(4)]
    sums = rows.groupBy("kind", "date").agg(F.count("*").alias("rows"), *[F.sum(p).alias(f"_{k}") for k, p in enumerate(parts)])
    return sums.select("kind", "date", "rows", F.sha2(F.concat_ws(":", "rows", *[F.col(f"_{k}").cast("string") for k in range(4)]), 256).alias("sha256"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[6:-5]) for n in scratch.names(spark, path) if n.startswith("index-") and n.endswith(".json"))


def read_index(spark: SparkSession, path: str, host: str = "") -> dict:
    """The newest index: an empty one if there is none, an error if it is damaged or another site's."""
    known = _versions(spark, path)
    if not known:
        return {"schema": sinks.INDEX_SCHEMA, "version": 0, "host": host, "baseline_date": None, "next_due": None, "snapshots": []}
    index = json.loads(scratch.read_text(spark, f"{path}/index-{known[-1]:09d}.json"))
    if not isinstance(index, dict) or index.get("schema") != sinks.INDEX_SCHEMA or not isinstance(index.get("snapshots"), list):
        raise ValueError(f"not an index of snapshots: {path}")
    if host and index.get("host") and index["host"].lower() != host.lower():
        raise ValueError(f"the index is of {index['host']}, not of {host}")
    return index


def _commit(spark: SparkSession, path: str, index: dict) -> None:
    scratch.write_new(spark, f"{path}/index-{index['version']:09d}.json", json.dumps(index, ensure_ascii=False, indent=2) + "\n")


def write(rows: DataFrame, path: str, host: str, force: bool = False, label: str | None = None, baseline: bool = False) -> dict:
    """Stores the snapshots of all kinds and dates in rows; the new index.

    ValueError names what is wrong with the rows (`sinks.snapshot_faults`) and FileExistsError a snapshot that exists, unless
    force replaces it; both before anything is written.  The first audit's date is the baseline, or that of a write with
    `baseline`.  No rows: nothing is written."""
    spark = rows.sparkSession
    index = read_index(spark, path, host)
    faults = sinks.snapshot_faults(rows, host).distinct().orderBy("kind", "date", "fault").limit(20).collect()
    if faults:
        raise ValueError("; ".join(f"{f['kind']} {f['date']}: {f['fault']}" for f in faults))
    given = {(r["kind"], r["date"]): r for r in digests(rows).collect()}
    old = {(s["kind"], s["date"]): s for s in index["snapshots"]}
    clash = sorted(given.keys() & old.keys())
    if clash and not force:
        raise FileExistsError("snapshots exist: " + ", ".join(" ".join(c) for c in clash))
    if not given:
        return index
    stage = f"data/{uuid.uuid4().hex}"
    try:
        rows.write.partitionBy("kind", "date").parquet(f"{path}/{stage}")
        staged = {(r["kind"], r["date"]): r for r in digests(spark.read.schema(rows.schema).parquet(f"{path}/{stage}")).collect()}
        if staged != given:
            raise OSError("what was written is not what was given")
        fresh = {k: {"kind": k[0], "date": k[1], "file": f"{stage}/kind={k[0]}/date={k[1]}", "sha256": r["sha256"], "label": label, "rows": r["rows"]} for k, r in given.items()}
        table = spark.createDataFrame([tuple(s[c.split()[0]] for c in ENTRY.split(", ")) for s in (old | fresh).values()], ENTRY)
        dates = sorted(d for k, d in given if k == "audit") or sorted(d for _, d in given)
        first = not any(k == "audit" for k, _ in old) and any(k == "audit" for k, _ in given)
        index |= {"version": index["version"] + 1, "host": index["host"] or host, "snapshots": [r.asDict() for r in messages.snapshots_in_order(table).collect()], "next_due": diff.next_due(table).first()["next_due"]}
        if first or baseline:
            index["baseline_date"] = dates[0] if first else dates[-1]
        _commit(spark, path, index)
    except BaseException:
        scratch.remove(spark, f"{path}/{stage}")
        raise
    return index


def read(spark: SparkSession, path: str, schema: str, kind: str | None = None, date: str | None = None) -> DataFrame:
    """Rows of the snapshots that the index names, of one kind or date if asked for; only their folders are read."""
    chosen = [s["file"] for s in read_index(spark, path)["snapshots"] if kind in (None, s["kind"]) and date in (None, s["date"])]
    if not chosen:
        return spark.createDataFrame([], schema)
    parts = {}
    for file in chosen:  # one read a write, so that kind and date come from the folders below it
        parts.setdefault(file.split("/kind=")[0], []).append(f"{path}/{file}")
    tables = [spark.read.schema(schema).option("basePath", f"{path}/{stage}").parquet(*files) for stage, files in parts.items()]
    found = tables[0]
    for t in tables[1:]:
        found = found.unionByName(t)
    return found


def damaged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """kind, date of snapshots whose rows are not those that the index has the hash of."""
    known = [(s["kind"], s["date"], s["sha256"]) for s in read_index(spark, path)["snapshots"]]
    index = spark.createDataFrame(known, "kind string, date string, known string")
    got = digests(read(spark, path, schema)).select("kind", "date", "sha256")
    return index.join(got, ["kind", "date"], "left").where("sha256 is null or sha256 <> known").select("kind", "date")
