"""Stuck-loop patterns in each session's latest operations, by windows over (session_id, pos)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from .stats import n_if

_OUT = ["session_id", "pattern_type", "normalized_pattern", "iterations", "started_at", "ended_at", "resolution"]


def occurrences(usages: DataFrame, last: int = rules.LOOP_OPERATIONS) -> DataFrame:
    """The last operations of each session, success only where explicit."""
    w = Window.partitionBy("session_id").orderBy(F.col("pos").desc())
    kept = usages.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= last).drop("rn")
    return kept.withColumn("success", F.coalesce("success", F.lit(False)))


def retry_loops(occ: DataFrame) -> DataFrame:
    """Three or more failures of a signature whose first and last are at most five minutes apart."""
    failed = ~F.col("success")
    per = occ.groupBy("session_id", "signature").agg(n_if(failed).alias("iterations"), F.min_by(F.when(failed, F.col("timestamp")), F.when(failed, F.col("pos"))).alias("started_at"), F.max_by(F.when(failed, F.col("timestamp")), F.when(failed, F.col("pos"))).alias("ended_at"), F.max_by("success", "pos").alias("last_ok"))
    kept = per.where((F.col("iterations") >= rules.LOOP_THRESHOLD) & (F.col("ended_at") - F.col("started_at") <= rules.LOOP_WINDOW_MS))
    resolution = F.when(F.col("last_ok"), "success").when(F.col("iterations") >= rules.ABANDONED_FAILURES, "abandoned")
    return kept.select("session_id", F.lit("retry").alias("pattern_type"), F.col("signature").alias("normalized_pattern"), "iterations", "started_at", "ended_at", resolution.alias("resolution"))


def oscillations(occ: DataFrame) -> DataFrame:
    """From each start, two signatures in turn, six operations or more within five minutes."""
    w = Window.partitionBy("session_id").orderBy("pos")
    s = F.col("signature")
    rows = occ.withColumns({"k": F.row_number().over(w), "alt": F.coalesce((s == F.lag("signature", 2).over(w)) & (s != F.lag("signature", 1).over(w)), F.lit(False))})
    rows = rows.withColumn("island", F.sum(F.when(F.col("alt"), 0).otherwise(1)).over(w))
    island = Window.partitionBy("session_id", "island")
    rows = rows.withColumns({"end_k": F.max("k").over(island), "end_ts": F.max_by("timestamp", "k").over(island)})
    ahead = rows.withColumns({"a2": F.lead("alt", 2).over(w), "e2": F.lead("end_k", 2).over(w), "t2": F.lead("end_ts", 2).over(w), "b": F.lead("signature", 1).over(w)})
    count = F.col("e2") - F.col("k") + 1
    kept = ahead.where(F.col("a2") & (count >= 2 * rules.LOOP_THRESHOLD) & (F.col("t2") - F.col("timestamp") <= rules.LOOP_WINDOW_MS))
    return kept.select("session_id", F.lit("oscillation").alias("pattern_type"), F.concat(s, F.lit(" <-> "), F.col("b")).alias("normalized_pattern"), F.floor(count / 2).alias("iterations"), F.col("timestamp").alias("started_at"), F.col("t2").alias("ended_at"), F.lit(None).cast("string").alias("resolution"))


def permission_loops(occ: DataFrame) -> DataFrame:
    """Three or more permission errors in a session within five minutes."""
    bad = occ.where(F.col("error").rlike(rules.PERMISSION_ERRORS))
    per = bad.groupBy("session_id").agg(F.count("*").alias("iterations"), F.min_by("timestamp", "pos").alias("started_at"), F.max_by("timestamp", "pos").alias("ended_at"))
    kept = per.where((F.col("iterations") >= rules.LOOP_THRESHOLD) & (F.col("ended_at") - F.col("started_at") <= rules.LOOP_WINDOW_MS))
    return kept.select("session_id", F.lit("permission_loop").alias("pattern_type"), F.lit("permission denied").alias("normalized_pattern"), "iterations", "started_at", "ended_at", F.lit(None).cast("string").alias("resolution"))


def dead_ends(occ: DataFrame) -> DataFrame:
    """A failure, then half a minute or more of nothing, then something else."""
    w = Window.partitionBy("session_id").orderBy("pos")
    rows = occ.withColumns({"next_ts": F.lead("timestamp").over(w), "next_sig": F.lead("signature").over(w)})
    kept = rows.where((F.col("next_ts") - F.col("timestamp") >= rules.PAUSE_MS) & ~F.col("success") & (F.col("next_sig") != F.col("signature")))
    return kept.select("session_id", F.lit("dead_end").alias("pattern_type"), F.col("signature").alias("normalized_pattern"), F.lit(1).cast("long").alias("iterations"), F.col("timestamp").alias("started_at"), F.col("timestamp").alias("ended_at"), F.lit("abandoned").alias("resolution"))


def loop_patterns(occ: DataFrame) -> DataFrame:
    out = retry_loops(occ)
    for f in (oscillations, permission_loops, dead_ends):
        out = out.unionByName(f(occ))
    return out.select(_OUT)


def loop_rollup(patterns: DataFrame) -> DataFrame:
    """Per session: patterns, retries, time in loops (times of 0 count as missing), severity."""
    spent = F.when((F.col("started_at") != 0) & (F.col("ended_at") != 0), F.col("ended_at") - F.col("started_at")).otherwise(0)
    has = lambda kind: F.max((F.col("pattern_type") == kind).cast("int"))
    per = patterns.groupBy("session_id").agg(F.count("*").alias("loops"), F.sum("iterations").alias("total_retries"), F.sum(spent).alias("time_in_loops_ms"), has("permission_loop").alias("p"), has("oscillation").alias("o"))
    severity = F.when((F.col("p") == 1) | (F.col("total_retries") > 10), "high").when((F.col("o") == 1) | (F.col("total_retries") > 5), "medium").otherwise("low")
    return per.select("session_id", "loops", "total_retries", "time_in_loops_ms", severity.alias("severity"))


def loops_by_type(patterns: DataFrame) -> DataFrame:
    return patterns.groupBy("pattern_type").agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("loops"), F.sum("iterations").alias("retries"))
