"""Writers: tables through Spark's committer, small documents whole or not at all."""
from __future__ import annotations

import csv
import io
import json
import os
import tempfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from .. import contracts as C


def write_bytes(path: str | Path, data: bytes) -> None:
    """A file appears with all of its bytes or stays as it was."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=".part-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_json(path: str | Path, document) -> None:
    write_bytes(path, (json.dumps(document, ensure_ascii=False, indent=2, sort_keys=False, default=str) + "\n").encode())


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a JSON-lines log; committed files are never touched again."""
    rows.write.mode("append").json(path)


def form_csv(rows: list[dict], path: str | Path) -> None:
    """A form to fill by hand: all columns, a byte-order mark for spreadsheet programs."""
    out = io.StringIO(newline="")
    writer = csv.DictWriter(out, C.FORM_COLUMNS, restval="", extrasaction="ignore", lineterminator="\r\n")
    writer.writeheader()
    writer.writerows(rows)
    write_bytes(path, b"\xef\xbb\xbf" + out.getvalue().encode())


def write_sitemaps(chunks: DataFrame, path: str, namespace: str, base: str | None = None) -> list[str]:
    """urls with chunk -> one whole sitemap file a chunk, made in the executors and in order; the names, in order.

    Files are made aside through Spark's committer and then named: sitemap.xml if there is one, else sitemap-1.xml and so on, and
    last sitemap_index.xml, which names the parts below base (if given).  A chunk is bound by the limits of the format, so one
    row holds its text; the driver sees the names of the parts alone, which the format's index bounds."""
    from pyspark.sql import functions as F

    from ..functions import text as X
    from . import scratch

    spark = chunks.sparkSession
    entry = F.concat(F.lit("  <url><loc>"), X.html_escape("url"), F.lit("</loc></url>\n"))
    body = chunks.groupBy("chunk").agg(F.array_join(F.array_sort(F.collect_list(F.struct("url", entry.alias("x"))))["x"], "").alias("x"))
    head = lambda tag: f'<?xml version="1.0" encoding="UTF-8"?>\n<{tag} xmlns="{namespace}">\n'
    aside = f"{path.rstrip('/')}/.made"
    body.repartition("chunk").select("chunk", F.concat(F.lit(head("urlset")), "x", F.lit("</urlset>")).alias("value")).write.mode("overwrite").partitionBy("chunk").text(aside)
    made = {int(folder.split("=")[1]): part for folder in scratch.names(spark, aside) if folder.startswith("chunk=") for part in [f"{aside}/{folder}/{p}" for p in scratch.names(spark, f"{aside}/{folder}") if p.startswith("part-")]}
    if not made:
        scratch.write_text(spark, f"{path}/sitemap.xml", head("urlset") + "</urlset>\n")
    files = ["sitemap.xml"] if len(made) < 2 else [f"sitemap-{k + 1}.xml" for k in range(len(made))]
    for name, chunk in zip(files, sorted(made)):
        scratch.rename(spark, made[chunk], f"{path}/{name}")
    scratch.remove(spark, aside)
    if len(made) > 1 and base is not None:
        locs = "".join(f"  <sitemap><loc>{escape(f'{base}/{name}')}</loc></sitemap>\n" for name in files)
        scratch.write_text(spark, f"{path}/sitemap_index.xml", head("sitemapindex") + locs + "</sitemapindex>\n")
        files.insert(0, "sitemap_index.xml")
    return files


def category(name: str) -> str:
    """What made a file: all sitemap files are one kind, both meta drafts another, else the first part of the name decides."""
    if name.startswith("sitemap") and name.endswith(".xml"):
        return "sitemap"
    return "meta" if name.startswith("meta-draft.") else name.split("/", 1)[0].split(".", 1)[0]


def collect_garbage(previous: list[str], current: list[str], remade: set[str], root: str | Path) -> list[str]:
    """Deletes files that an earlier run made and this one, which made their categories again, did not; never outside root."""
    root, gone = Path(root).resolve(), []
    for name in sorted(set(previous) - set(current)):
        path = (root / name).resolve()
        if category(name) in remade and path.is_relative_to(root) and path.is_file():
            path.unlink()
            gone.append(name)
    return gone


def archive(path: str | Path, folder: str | Path, stamp: str) -> Path | None:
    """A copy of a document under its time before a new one takes its place; None if there is none yet."""
    path = Path(path)
    if not path.exists():
        return None
    copy = Path(folder) / f"{path.stem}-{stamp}{path.suffix}"
    write_bytes(copy, path.read_bytes())
    return copy


def init_queries(path: str | Path) -> bool:
    """A question set to fill in, unless there is one; whether it was written."""
    if Path(path).exists():
        return False
    rows = [{"id": f"{kind[0]}{i}", "text": f"{C.TODO}: question>>", "type": kind, "note": ""} for kind in C.QUERY_TYPES for i in (1, 2)]
    write_json(path, {"schema": "sitewright/queries/2", "queries": rows})
    return True


MANIFEST, MANIFEST_SCHEMA = "generated-files.json", "sitewright/generated-files/1"
INDEX_SCHEMA = "sitewright/history/1"


def write_meta(drafts: DataFrame, path: str) -> None:
    """Meta drafts as CSV with a header and as JSON lines, a row a page."""
    flat = drafts.select(*[c for c, t in drafts.dtypes if not t.startswith(("array", "map", "struct"))])
    flat.write.mode("overwrite").option("header", True).option("lineSep", "\n").option("escape", '"').csv(f"{path}/meta-draft.csv")
    drafts.write.mode("overwrite").json(f"{path}/meta-draft.json")


def read_manifest(root: str | Path) -> list[str]:
    """Files that the last run made; none if there is no manifest or not one of ours."""
    try:
        found = json.loads((Path(root) / MANIFEST).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return []
    return list(found.get("files") or []) if isinstance(found, dict) and found.get("schema") == MANIFEST_SCHEMA else []


def finish_files(written: list[str], remade: set[str], root: str | Path) -> list[str]:
    """Deletes what an earlier run made and this one did not, and writes down what is ours now; the files deleted."""
    previous = read_manifest(root)
    gone = collect_garbage(previous, written, remade, root)
    others = {name for name in previous if category(name) not in remade}
    write_json(Path(root) / MANIFEST, {"schema": MANIFEST_SCHEMA, "files": sorted(others | set(written))})
    return gone


def snapshot_faults(rows: DataFrame, host: str) -> DataFrame:
    """kind, date, fault of rows (kind, date, host, schema) that must not be stored: before anything is written."""
    from pyspark.sql import functions as F

    from ..functions import text as X

    tests = (
        ("kind", ~F.coalesce(F.col("kind").isin(*C.SNAPSHOT_KINDS), F.lit(False))), ("date", X.strict_date("date").isNull()),
        ("schema", ~F.coalesce(F.col("schema").contains(F.concat(F.lit("/"), "kind", F.lit("/"))), F.lit(False))),
        ("host", ~F.coalesce(F.lower("host") == host.lower(), F.lit(False))))
    return rows.select("kind", "date", F.explode(F.array_compact(F.array(*[F.when(t, n) for n, t in tests]))).alias("fault"))


def read_index(path: str | Path, host: str = "") -> dict:
    """The index of a site's snapshots: an empty one if there is none, an error if it is damaged or another site's."""
    path = Path(path)
    if not path.exists():
        return {"schema": INDEX_SCHEMA, "host": host, "baseline_date": None, "next_due": None, "snapshots": []}
    index = json.loads(path.read_text(encoding="utf-8"))
    if not isinstance(index, dict) or index.get("schema") != INDEX_SCHEMA or not isinstance(index.get("snapshots"), list):
        raise ValueError(f"not an index of snapshots: {path}")
    if host and index.get("host") and index["host"].lower() != host.lower():
        raise ValueError(f"the index is of {index['host']}, not of {host}")
    return index


def write_index(snapshots: DataFrame, path: str | Path, host: str) -> dict:
    """The index made anew from the stored snapshots (kind, date, file, sha256, label), in their order; one row a run of the audit."""
    from ..operators import diff, messages

    index = read_index(path, host)
    rows = [r.asDict() for r in messages.snapshots_in_order(snapshots.select("kind", "date", "file", "sha256", "label")).collect()]
    index |= {"snapshots": rows, "next_due": diff.next_due(snapshots).first()["next_due"], "baseline_date": index["baseline_date"] or min((r["date"] for r in rows if r["kind"] == "measure"), default=None)}
    write_json(path, index)
    return index
