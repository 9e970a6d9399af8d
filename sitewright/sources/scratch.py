"""What is written to cut a plan: to spark.checkpoint.dir, the folder that the driver and all executors share."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The shared folder.  Where none is named, a run on one machine gets a temporary one and a cluster an error."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sitewright-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written as a checkpoint."""
    root(df.sparkSession)
    return df.checkpoint()


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared one, which goes when the application ends."""
    where = f"{root(spark)}/{tag}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(path)
    return where


def table(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet, so that each later reader takes only its columns."""
    where = folder(df.sparkSession, tag)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


# ---- files on whatever file system a path names ---------------------------------------------------------------------


def _at(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def names(spark: SparkSession, where: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, path = _at(spark, where)
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def rename(spark: SparkSession, old: str, new: str) -> None:
    """A file takes the place of another, if there is one."""
    fs, path = _at(spark, new)
    if fs.exists(path):
        fs.delete(path, False)
    if not fs.rename(_at(spark, old)[1], path):
        raise OSError(f"cannot rename {old} to {new}")


def remove(spark: SparkSession, where: str) -> None:
    fs, path = _at(spark, where)
    fs.delete(path, True)


def read_text(spark: SparkSession, where: str) -> str | None:
    """The text of a small file; None if there is none."""
    fs, path = _at(spark, where)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, where: str, text: str) -> None:
    """A small file, written aside and then named."""
    fs, path = _at(spark, f"{where}.next")
    stream = fs.create(path, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename(spark, f"{where}.next", where)


def write_new(spark: SparkSession, where: str, text: str) -> None:
    """A small file, written aside and then named; FileExistsError if the name is taken by then."""
    aside = f"{where}.{uuid.uuid4().hex}"
    write_text(spark, aside, text)
    fs, path = _at(spark, where)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
    rename_of = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename_of, 1)
    options[0] = rename_of.NONE
    try:
        context.rename(fs.makeQualified(_at(spark, aside)[1]), fs.makeQualified(path), options)
    except Exception as e:
        remove(spark, aside)
        if fs.exists(path):
            raise FileExistsError(where) from e
        raise
