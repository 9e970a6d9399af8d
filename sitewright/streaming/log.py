"""The observation log as a stream.

A correction may come at any later time, so a watermark cannot be exact for last-wins: each micro-batch is merged into
the tables of just the dates that it touches.  Daily counts with bounded lateness are the second query."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts as C
from ..operators import measure as M
from ..sources.tables import valid_rows


def read(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    rows = spark.readStream.schema(C.LOG).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return valid_rows(rows)


def keep_latest(rows: DataFrame, target: str, checkpoint: str):
    """Writes the stream into `target`, partitioned by date, one row a key; the last recorded wins."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            dates = [r[0] for r in batch.select("date").distinct().collect()]  # dates of one micro-batch
            if not dates:
                return
            fresh = batch.withColumn("batch", F.lit(number))
            try:
                old = spark.read.parquet(target).where(F.col("date").cast("string").isin(dates)).withColumn("date", F.col("date").cast("string"))
                fresh = fresh.unionByName(old.select(*fresh.columns))
            except Exception as e:  # nothing written yet
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
            merged = M.last_wins(fresh, "batch", "recorded_at")
            staged = f"{target}.next"
            merged.write.mode("overwrite").parquet(staged)
            (spark.read.schema(merged.schema).parquet(staged).repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(target))
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(rows: DataFrame, late: str = "3 days") -> DataFrame:
    """Counts per day and engine, closed once the watermark has passed the day."""
    timed = rows.withColumn("at", F.try_to_timestamp(F.col("recorded_at"))).where("at is not null").withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 day").alias("day"), "engine").agg(*M.counts()).select("day.start", "engine", "attempts", "runs", "cited", "errors")
