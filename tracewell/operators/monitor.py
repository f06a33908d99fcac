"""Series of scans: agent state, first seen, what came and went, ports and processes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def agent_states(samples: DataFrame, busy: float = 1.0, stalled_ms: int = 30_000, young_ms: int = 10_000) -> DataFrame:
    """samples (pid, timestamp, cpu, start_time ms): WORKING at ``busy`` percent or more; else STALLED after
    ``stalled_ms`` of quiet if the process is older than ``young_ms``; else WAITING. Quiet counts from the last busy
    sample, before any from 5 s after the start."""
    w = Window.partitionBy("pid").orderBy("timestamp")
    last = F.last(F.when(F.col("cpu") >= busy, F.col("timestamp")), ignorenulls=True).over(w)
    quiet = F.col("timestamp") - F.coalesce(last, F.col("start_time") + 5_000)
    state = F.when(F.col("cpu") >= busy, "WORKING").when((quiet > stalled_ms) & (F.col("timestamp") - F.col("start_time") > young_ms), "STALLED").otherwise("WAITING")
    return samples.withColumn("state", state)


def first_seen(scans: DataFrame, key: list[str]) -> DataFrame:
    """scans (key..., scan, timestamp): when the present run of consecutive scans with the key began."""
    w = Window.partitionBy(*key).orderBy("scan")
    starts = F.coalesce(F.col("scan") - F.lag("scan").over(w) > 1, F.lit(True))
    runs = scans.withColumn("run", F.sum(starts.cast("int")).over(w))
    return runs.withColumn("first_seen", F.min("timestamp").over(Window.partitionBy(*key, "run"))).drop("run")


def lifecycle(scans: DataFrame, key: list[str]) -> DataFrame:
    """Start and end events: a key that was not in the scan before, or is not in the next one (the last scan ends nothing)."""
    w = Window.partitionBy(*key).orderBy("scan")
    last = scans.agg(F.max("scan").alias("last_scan"))
    rows = scans.crossJoin(F.broadcast(last)).withColumns({"was": F.lag("scan").over(w), "then": F.lead("scan").over(w)})  # one row
    began = F.when(F.col("was").isNull() | (F.col("scan") - F.col("was") > 1), F.struct(F.lit("start").alias("event"), F.col("scan").alias("at")))
    ended = F.when((F.coalesce(F.col("then"), F.col("last_scan") + 1) - F.col("scan") > 1) | (F.col("then").isNull() & (F.col("scan") < F.col("last_scan"))), F.struct(F.lit("end").alias("event"), (F.col("scan") + 1).alias("at")))
    return rows.select(*key, F.explode(F.array_compact(F.array(began, ended))).alias("e")).select(*key, "e.event", "e.at")


def sampled(scans: DataFrame, every: int = 10) -> DataFrame:
    return scans.where(F.col("scan") % every == 0)


def port_agents(ports: DataFrame, agents: DataFrame, parents: DataFrame) -> DataFrame:
    """Each port's agent: the process itself, else its parent."""
    a = agents.select("pid", "label")
    direct = ports.join(a.withColumnRenamed("label", "own"), "pid", "left").join(parents.select("pid", "ppid"), "pid", "left")
    return direct.join(a.select(F.col("pid").alias("ppid"), F.col("label").alias("above")), "ppid", "left").withColumn("agent_label", F.coalesce("own", "above")).drop("own", "above")


def without_children(processes: DataFrame) -> DataFrame:
    """Processes whose parent is not an agent process of the same label."""
    parents = processes.select(F.col("pid").alias("ppid"), "label")
    return processes.join(parents, ["ppid", "label"], "left_anti")


def rotation(files: DataFrame, as_of_day: str, keep_days: int, keep_files: int) -> DataFrame:
    """files (prefix, name, date): whether each is deleted: too old, or beyond the newest ``keep_files`` of its prefix."""
    old = F.datediff(F.lit(as_of_day).cast("date"), F.col("date").cast("date")) > keep_days
    rank = F.row_number().over(Window.partitionBy("prefix", "old").orderBy(F.col("date").desc(), F.col("name").desc()))
    return files.withColumn("old", old).withColumn("deleted", F.col("old") | (rank > keep_files)).drop("old")


def backoff_ms(failures, first: int = 5_000, most: int = 60_000):
    """Delay before the next scan of a failing repository."""
    return F.least(F.lit(most).cast("double"), F.lit(first) * F.pow(F.lit(2.0), F.greatest(failures - 1, F.lit(0)))).cast("long")
