"""Shared helpers: scratch tables in the cluster's shared folder, folds, array scans, sampling."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


LABELS = 10_000  # values of a label or language that a model may tell apart


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; a column that is missing reads as null, others are left out."""
    have = {c.lower() for c in df.columns}
    return df.select(*[(F.col(c) if c.lower() in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def unlike(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.  Where it is unset, a run on one machine gets a temporary folder and a
    cluster an error, since its executors would each write to a disk of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sitewright-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor rereads them, nothing is recomputed.  The
    folder goes when the application ends, unless it holds a result (`keep`)."""

    def __init__(self, spark: SparkSession, tag: str, keep: bool = False):
        self.spark, self.root = spark, f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
        if not keep:
            path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame, compression: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def small_batches(df: DataFrame, most: int = 16 << 20) -> DataFrame:
    """df, after the session's limit on the bytes of an Arrow batch is lowered to `most` (never raised): what a Python
    worker and the buffers beside the heap hold at once does not depend on how long texts are."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key, "64m")
    if now.lower().rstrip("b").isdigit() and int(now.lower().rstrip("b")) > most or now.lower() == "64m":
        conf.set(key, str(most))
    return df


def trim() -> None:
    """Gives freed memory of the Python process back to the system, where the C library can."""
    import ctypes
    import gc

    gc.collect()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, inside one expression."""
    return F.transform(F.array(value), body)[0]


def scan(values: Column, op, start: Column, block: int = 256) -> Column:
    """Inclusive running op over an array, in two levels so that the copying stays near linear."""

    def run(part: Column, zero: Column) -> Column:
        grown = F.aggregate(part, F.array(zero), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))
        return F.slice(grown, 2, F.size(grown))

    def whole(arr: Column) -> Column:
        n_blocks = (F.size(arr) + F.lit(block - 1)) / F.lit(block)
        blocks = F.transform(F.sequence(F.lit(0), F.floor(n_blocks).cast("int") - 1), lambda b: run(F.slice(arr, b * block + 1, block), start))

        def join_up(bs: Column) -> Column:
            ends = F.concat(F.array(start), run(F.transform(bs, lambda b: F.element_at(b, -1)), start))
            return let(ends, lambda e: F.flatten(F.transform(bs, lambda b, i: F.transform(b, lambda x: op(F.get(e, i), x)))))

        return let(blocks, join_up)

    return F.when(F.size(values) > 0, let(values, whole)).otherwise(F.slice(F.array(start), 1, 0))


def place(key: Column) -> Column:
    """Where a key's hash lies in [0, 1)."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))


def class_shares(keys: DataFrame, label: str, per_class: int) -> DataFrame:
    """label, _share: the share of the hash range that holds about per_class of a label's distinct keys.  A table of as many rows
    as there are labels, for all executors: more than ``LABELS`` are refused."""
    counts = keys.groupBy(label).count().limit(LABELS + 1).collect()
    if len(counts) > LABELS:
        raise ValueError(f"more than {LABELS} values of {label}")
    return keys.sparkSession.createDataFrame([(r[label], per_class / r["count"]) for r in counts], keys.select(label).schema.add("_share", "double"))
