"""The driver's tables seen as the typed tables of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_command

#: what stands for "now": the end of the events' month, so that results do not depend on the clock
AS_OF = 1_706_659_200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str) -> Column:
    """Epoch milliseconds of a timestamp without zone, read as UTC."""
    return F.unix_millis(F.col(ts).cast("timestamp"))


def usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls: the user is the session, the type the tool, the value the duration; errors failed."""
    e = table(spark, sf_dir, "events").withColumn("ms", millis("ts"))
    out = e.select(
        F.col("user_id").cast("string").alias("session_id"), F.struct("ms", "event_id").alias("pos"), F.col("event_id").cast("string").alias("tool_use_id"), F.col("event_type").alias("tool_name"), F.col("props").alias("tool_input"),
        F.col("ms").alias("timestamp"), (F.col("ms") + F.floor("value")).alias("completed_at"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("duration_ms"),
    )
    return out.withColumn("signature", F.concat("tool_name", F.lit(":"), normalize_command(F.coalesce("tool_input", F.lit("")))))


def coarse_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``usages``, with time run 5000 times faster and the tool as signature, so that loops occur."""
    u = usages(spark, sf_dir)
    fast = lambda c: F.floor(F.col(c) / 5000)
    return u.withColumns({"timestamp": fast("timestamp"), "completed_at": fast("completed_at"), "signature": F.col("tool_name"), "error": F.when(~F.col("success"), F.when(F.col("duration_ms") > 50, "permission denied").otherwise("unknown error"))})


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usages(spark, sf_dir)
    return u.groupBy("session_id").agg(F.min("timestamp").alias("start_time"), F.max("completed_at").alias("last_activity"), F.count("*").alias("tool_count"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored sessions: id, modified_at, score 0 to 100 (null for views of a multiple of 7), feedback."""
    e = table(spark, sf_dir, "events")
    score = F.when((F.col("event_type") == "view") & (F.col("event_id") % 7 == 0), None).otherwise(F.pmod(F.col("event_id") * 37, F.lit(101)))
    feedback = F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "negative")
    return e.select(F.col("event_id").alias("id"), millis("ts").alias("modified_at"), score.alias("score"), feedback.alias("feedback"), F.col("event_type").alias("kind"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("event_type").alias("category"), F.when(F.col("value") > 50, "large").otherwise("small").alias("action"))
