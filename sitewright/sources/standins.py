"""The driver's tables in the shapes of the audited data model."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries(spark: SparkSession) -> DataFrame:
    """Ten questions Q0 to Q9, the first four with the brand's name."""
    q = spark.range(10).select(F.concat(F.lit("Q"), "id").alias("id"), F.concat(F.lit("question "), "id").alias("text"), F.when(F.col("id") < 4, "brand").otherwise("nonbrand").alias("type"))
    return q.withColumns({"note": F.lit(""), "fingerprint": X.fingerprint("type", "text")})


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observation log from `events`; rows are in order of ts and event_id."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    uid, eid = F.col("user_id"), F.col("event_id")
    outcome = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "unmeasured").otherwise("observed")
    cited = F.col("event_type") == "purchase"
    none = F.expr("cast(array() as array<string>)")
    urls = F.when(cited, F.array(F.format_string("https://www.s%d.example.com/p%d", eid % 6, eid % 4), F.format_string("https://t%d.example.org/", eid % 9))).otherwise(none)
    text = F.concat(F.lit("question "), (uid % 10).cast("string"))
    return e.select(
        F.lit("measure-row/2").alias("schema"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.concat(F.lit("Q"), (uid % 10).cast("string")).alias("query_id"),
        F.get(F.array(F.lit("chatgpt"), F.lit("google_aio"), F.lit("gemini")), (uid % 3).cast("int")).alias("engine"), (k % 5 + 1).alias("run_no"), F.lit("manual").alias("mode"),
        F.lit("").alias("surface"), F.when(uid % 2 == 0, "en").otherwise("ko").alias("locale"), F.lit("signed_out").alias("login_state"),
        F.when(uid % 5 == 0, F.lit(None)).otherwise(uid % 2 == 0).cast("boolean").alias("search_enabled"), F.lit("").alias("campaign_id"),
        F.when(uid % 10 == 9, "old").otherwise(X.fingerprint(F.when(uid % 10 < 4, "brand").otherwise("nonbrand"), text)).alias("query_fingerprint"), F.lit("").alias("model"), F.lit(True).alias("signed_out"),
        outcome.alias("outcome"), F.when(outcome == "error", "timeout").alias("error"), F.when(outcome == "observed", cited).alias("cited"), urls.alias("cited_urls"),
        F.col("event_type").isin("purchase", "click").alias("brand_mentioned"), F.when(outcome == "observed", F.array(F.format_string("c%d.example.net", eid % 30))).otherwise(none).alias("competitor_domains"),
        F.lit("").alias("note"), F.col("ts").cast("string").alias("recorded_at"), "ts", "event_id")
