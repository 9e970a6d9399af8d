"""Readers with explicit schemas: observation logs, question sets, forms, snapshots, packages, audit documents, logs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import contracts as C
from ..functions import text as X


def line_place():
    """Where a line stands in its file: the split's first byte, then the place in the split.  A split is read by one task from its
    start, so this is the order of the file however splits are cut, or packed into tasks; compared, never counted."""
    return F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON-lines log with file and line (`line_place`): later is a greater (file, line), files by name; what is no valid
    row is left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), line_place().alias("line"))
    return valid_rows(lines.select("file", "line", F.from_json("value", C.LOG).alias("r")).select("file", "line", "r.*"))


def valid_rows(rows: DataFrame) -> DataFrame:
    """Rows with a date, a known schema, engine and, from version 2 on, outcome; version 1 rows count as observed."""
    version = F.regexp_extract("schema", r"measure-row/([12])\z", 1)
    good = X.falsy("date", F.lit(None)).isNotNull() & (version != "") & F.col("engine").isin(*C.ENGINES) & ((version == "1") | F.col("outcome").isin(*C.OUTCOMES))
    return rows.where(good).withColumn("outcome", F.coalesce("outcome", F.lit("observed")))


def query_set(raw: DataFrame) -> DataFrame:
    """(pos, id, text, type, note) as listed -> valid questions with fingerprints; the first of an id wins, even if its text is blank."""
    rows = raw.where(X.collapse("id") != "").withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where("_rn = 1")
    rows = rows.where(F.col("type").isin(*C.QUERY_TYPES) & (X.collapse(F.coalesce("text", F.lit(""))) != ""))
    return rows.select("id", "text", "type", F.coalesce("note", F.lit("")).alias("note"), X.fingerprint("type", "text").alias("fingerprint"))


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.option("multiLine", True).schema("schema string, queries array<struct<id:string,text:string,type:string,note:string>>").json(path)
    known = F.col("schema").rlike(r"queries/[12]\z")
    checked = doc.select(F.when(known, F.col("queries")).otherwise(F.raise_error(F.lit("not a question set"))).alias("queries"))
    return query_set(checked.select(F.posexplode("queries").alias("pos", "q")).select("pos", "q.*"))


def read_form(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Filled forms, all columns as text, with the file; a byte-order mark before the first name is removed."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(paths)
    raw = raw.withColumns({"file": F.col("_metadata.file_path"), "line": line_place()})
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    have = set(raw.columns)
    return raw.select("file", "line", *[(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in C.FORM_COLUMNS])


def read_documents(spark: SparkSession, path: str, family: str) -> DataFrame:
    """Whole JSON documents of one schema family: file, sha256, body; another family stops the read."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("body"))
    kind = F.get_json_object("body", "$.schema")
    return files.withColumn("body", F.when(F.coalesce(F.regexp_like(kind, F.lit(rf"{family}/[0-9]+\z")), F.lit(False)), F.col("body")).otherwise(F.raise_error(F.concat(F.lit("unexpected schema in "), "path"))))


def read_snapshots(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """Snapshot documents named by an index; a stored hash that does not fit the bytes stops the read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("file"), F.sha2("content", 256).alias("_found"), F.decode("content", "UTF-8").alias("body"))
    both = index.join(files, "file")
    return both.withColumn("body", F.when(F.col("_found") == F.col("sha256"), F.col("body")).otherwise(F.raise_error(F.concat(F.lit("changed snapshot "), "file")))).drop("_found")


def read_package(spark: SparkSession, folder: str) -> DataFrame:
    """kind, name, body of the files of a generated package; broken JSON has a null body."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("name"), F.col("path").contains("/jsonld/").alias("ld"), F.decode("content", "UTF-8").alias("body"))
    kind = F.when(F.col("name") == "robots.txt", "robots").when(F.col("name") == "llms.txt", "llms").when(F.col("name").rlike(r"^sitemap.*\.xml\z"), "sitemap").when(
        F.col("name") == "manifest.json", "manifest").when(F.col("ld") & F.col("name").endswith(".json"), "jsonld").when(F.col("name") == "meta-draft.json", "meta")
    json_kind = kind.isin("manifest", "jsonld", "meta")
    return files.select(kind.alias("kind"), "name", F.when(~json_kind | F.try_parse_json("body").isNotNull(), F.col("body")).alias("body")).where("kind is not null")


def robots_body(responses: DataFrame) -> DataFrame:
    """url, status, present, raw: a robots.txt counts only with status 200 and if it is no HTML page."""
    good = (F.col("status") == 200) & ~F.ltrim("body").startswith("<")
    return responses.select("url", "status", F.coalesce(good, F.lit(False)).alias("present"), F.when(good, F.col("body")).otherwise("").alias("raw"))


def artifact_status(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """missing, recorded or invalid for each expected document."""
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("name"), F.decode("content", "UTF-8").alias("body"), "modificationTime")
    state = F.when(F.col("body").isNull(), "missing").when(F.try_parse_json("body").isNull() | F.get_json_object("body", "$.schema").isNull(), "invalid").otherwise("recorded")
    return wanted.join(files, "name", "left").select("name", state.alias("state"), F.get_json_object("body", "$.schema").alias("schema"), "modificationTime")


def parse_answer(answers: DataFrame, kind: str) -> DataFrame:
    """Cited URLs and text of stored API answers (column body): only URLs marked as citations count."""
    if kind == "openai":
        shape = "struct<output:array<struct<content:array<struct<text:string,annotations:array<struct<type:string,url:string>>>>>>,_error:string>"
        parts = F.flatten(F.transform(F.coalesce("a.output", F.array()), lambda o: F.coalesce(o["content"], F.array())))
        urls = F.flatten(F.transform(parts, lambda p: F.transform(F.filter(F.coalesce(p["annotations"], F.array()), lambda x: x["type"].contains("citation")), lambda x: x["url"])))
    else:
        shape = "struct<content:array<struct<type:string,text:string,citations:array<struct<url:string>>>>,_error:string>"
        parts = F.coalesce("a.content", F.array())
        urls = F.flatten(F.transform(parts, lambda p: F.transform(F.coalesce(p["citations"], F.array()), lambda x: x["url"])))
    read = answers.withColumn("a", F.from_json("body", shape))
    text = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "")
    return read.select(*answers.columns, F.array_distinct(F.array_compact(urls)).alias("cited_urls"), text.alias("text"), F.col("a._error").alias("error"))


def fetch_all(urls: DataFrame, fetch, per_host_pause: float = 0.5) -> DataFrame:
    """Responses of distinct URLs through `fetch(url) -> dict of RESPONSE fields`, one host to a task at a time so that the
    pause between requests holds; fetch is injected, nothing here opens a connection by itself."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T._parse_datatype_string(C.RESPONSE)
    arrow = to_arrow_type(schema)

    def run(batches):
        import time

        for batch in batches:
            rows = []
            for i, url in enumerate(batch.column("url").to_pylist()):
                if i and per_host_pause:
                    time.sleep(per_host_pause)
                row = {"url": url} | fetch(url)
                rows.append({f: row.get(f) if f != "headers" else list((row.get(f) or {}).items()) for f in schema.fieldNames()})
            yield pa.RecordBatch.from_struct_array(pa.array(rows, arrow))

    from ..functions import urls as U

    return urls.select("url").distinct().repartition(U.host_of("url")).mapInArrow(run, schema)
