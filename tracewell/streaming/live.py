"""Live counterparts as Structured Streaming queries. Event time is the payload's; state is bounded by watermarks."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.logs import EVENT

HOOK_EVENT = "event string, tool_use_id string, session_id string, tool_name string, timestamp long, error string, cwd string, input_tokens long, output_tokens long, commit string, seq long"
SESSION = (
    "session_id string, status string, start_time long, end_time long, last_activity long, tool_count long, awaiting_user boolean, input_tokens long, output_tokens long, "
    "auto_continue_attempts long, version long, tools_used array<struct<tool_name:string,n:bigint>>, commits array<string>"
)
_SESSION_STATE = "status string, start_time long, end_time long, last_activity long, tool_count long, awaiting_user boolean, input_tokens long, output_tokens long, auto_continue_attempts long, version long"


def read_stream(spark: SparkSession, folder: str, schema: str = HOOK_EVENT, files_per_trigger: int | None = None) -> DataFrame:
    """A drop folder of JSON lines; lines that do not parse are left out."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.json(folder)
    return rows.where(F.coalesce(*[F.col(c).cast("string") for c in rows.columns[:2]]).isNotNull())


def read_hooks(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Hook events of a drop folder with ``arrival``: their number ``seq`` if they have one, then the time and name of
    their file and their place in it, as a text that sorts in that order."""
    rows = read_stream(spark, folder, HOOK_EVENT, files_per_trigger)
    m, number = F.col("_metadata"), lambda c: F.lpad(c.cast("string"), 19, "0")
    placed = rows.withColumn("arrival", F.concat_ws("/", number(F.coalesce("seq", F.lit(0))), number(F.unix_micros(m.file_modification_time)), m.file_name, number(m.file_block_start)))

    def numbered(batches):
        n = 0  # a task reads a file from its first line to its last
        for batch in batches:
            line = pc.utf8_lpad(pc.cast(pa.array(range(n, n + len(batch)), pa.int64()), pa.string()), 19, "0")
            n += len(batch)
            yield batch.set_column(batch.schema.get_field_index("arrival"), "arrival", pc.binary_join_element_wise(batch.column("arrival"), line, "/"))

    return placed.mapInArrow(numbered, placed.schema)


def events(spark: SparkSession, folder: str) -> DataFrame:
    return read_stream(spark, folder, EVENT)


def paired_calls(hooks: DataFrame, late: str = "1 hour", longest: str = "1 hour") -> DataFrame:
    """Begins joined to their ends within ``longest``; begins without an end come out once the watermark passes them."""
    at = hooks.withColumn("at", F.timestamp_millis("timestamp"))
    begin = at.where("event = 'pre'").select("tool_use_id", "session_id", "tool_name", F.col("timestamp").alias("started_at"), F.col("at").alias("begin_at")).withWatermark("begin_at", late)
    end = at.where("event = 'post'").select(F.col("tool_use_id").alias("end_id"), F.col("timestamp").alias("completed_at"), "error", F.col("at").alias("end_at")).withWatermark("end_at", late)
    on = (F.col("tool_use_id") == F.col("end_id")) & (F.col("end_at") >= F.col("begin_at")) & (F.col("end_at") <= F.col("begin_at") + F.expr(f"interval {longest}"))
    out = begin.join(end, on, "leftOuter")
    return out.select("tool_use_id", "session_id", "tool_name", "started_at", "completed_at", (F.col("completed_at") - F.col("started_at")).alias("duration_ms"), F.when(F.col("completed_at").isNotNull(), F.col("error").isNull()).alias("success"))


def live_tool_stats(completed: DataFrame) -> DataFrame:
    """Running counts per tool; write with outputMode update or complete."""
    return completed.groupBy("tool_name").agg(F.count("*").alias("total_calls"), F.count(F.when(F.col("success"), 1)).alias("success_count"), F.avg("duration_ms").alias("avg_duration_ms"))


def windowed_counts(rows: DataFrame, width: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Events per window and category; a window closes when the watermark passes it."""
    at = rows.withColumn("at", F.to_timestamp("timestamp")).withWatermark("at", late)
    return at.groupBy(F.window("at", width), "category").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "category", "n")


def unique_events(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """One event per id within the watermark: a change that two components report is one event."""
    return rows.withColumn("at", F.to_timestamp("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])


#: transformWithState keeps its state in RocksDB
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionProcessor(StatefulProcessor):
    """The state of one session: a value, counts of completed calls by tool, the list of its commits, and a timer.

    Each call of the state store goes to the JVM and back, so a batch's events are worked on in memory: what there was is
    read once, and what has changed is written once at the end. Rows come and go many sessions to a batch of Arrow.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", _SESSION_STATE)
        self.tools = handle.getMapState("tools", "tool_name string", "n long")
        self.commits = handle.getListState("commits", "commit string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.session.get()
        current = list(held) if held is not None else None
        due = self._due(current) if current else None
        tools = {k[0]: v[0] for k, v in self.tools.iterator()} if current else {}
        commits = [c[0] for c in self.commits.get()] if current else []
        had_tools, had_commits = dict(tools), len(commits)
        anew = False
        for r in sorted(rows, key=lambda r: r.arrival):
            event, ms = r.event, r.timestamp
            if event == "start":  # also of a known session: it begins anew
                current = ["active", ms, None, ms, 0, False, 0, 0, 0, current[9] if current else 0]
                tools, commits, anew = {}, [], True
            if current is None:
                continue
            if event == "end":
                current[0], current[2] = "ended", ms
                continue
            if event == "auto_continue":
                current[8] += 1
                continue
            if event == "auto_continue_reset":
                current[8] = 0
                continue
            current[3] = max(current[3], ms)
            if event == "pre":
                current[4], current[5] = current[4] + 1, False
            elif event == "post" and r.tool_name is not None:
                tools[r.tool_name] = tools.get(r.tool_name, 0) + 1
            elif event in ("awaiting", "resumed"):
                current[5] = event == "awaiting"
            elif event == "tokens":
                current[6] += r.input_tokens or 0
                current[7] += r.output_tokens or 0
            elif event == "commit" and r.commit is not None:
                commits.append(r.commit)
        if current is not None:
            current[9] = max(current[9] + 1, self._now())
            self.session.update(tuple(current))
            self._keep(tools, commits, {} if anew else had_tools, 0 if anew else had_commits, anew and bool(had_tools), anew and had_commits > 0)
            if due != self._due(current):
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(self._due(current))
            yield self._rows(key, current, tools, commits)

    def _due(self, current: list) -> int:
        """When the timer of a session in this state is due."""
        return max(current[3], current[2] or 0) + self.idle_ms

    def _keep(self, tools: dict, commits: list, had_tools: dict, had_commits: int, clear_tools: bool, clear_commits: bool) -> None:
        if clear_tools:
            self.tools.clear()
        if clear_commits:
            self.commits.clear()
        for tool, n in tools.items():
            if had_tools.get(tool) != n:
                self.tools.updateValue((tool,), (n,))
        if len(commits) > had_commits:
            self.commits.appendList([(c,) for c in commits[had_commits:]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        current = list(self.session.get())
        if current[0] == "active":
            current[0], current[2] = "ended", current[3]
            tools, commits = {k[0]: v[0] for k, v in self.tools.iterator()}, [c[0] for c in self.commits.get()]
            yield self._rows(key, [*current[:9], max(current[9] + 1, self._now())], tools, commits)
        self.session.clear()
        self.tools.clear()
        self.commits.clear()

    @staticmethod
    def _now() -> int:
        return time.time_ns() // 1000

    @staticmethod
    def _rows(key, current: list, tools: dict, commits: list) -> Row:
        status, start, end, last, calls, awaiting, tokens_in, tokens_out, attempts, version = current
        used = [Row(tool_name=k, n=n) for k, n in sorted(tools.items())]
        return Row(
            session_id=key[0], status=status, start_time=start, end_time=end, last_activity=last, tool_count=calls, awaiting_user=awaiting, input_tokens=tokens_in, output_tokens=tokens_out,
            auto_continue_attempts=attempts, version=version, tools_used=used, commits=commits,
        )

    def close(self) -> None:
        pass


def live_sessions(hooks: DataFrame, idle_ms: int = 3_600_000, late: str = "1 hour") -> DataFrame:
    """Session state by start, pre, post, awaiting, resumed, tokens, commit, auto_continue (and its reset) and end events.

    hooks as of ``read_hooks``, with ``arrival``: events of a batch are taken in order of arrival, whatever their times
    say; of equal times that which came first is first. Events of sessions that have not started are ignored; a start
    of a known session begins it anew. Each batch gives the state of the sessions that it touched, numbered by
    ``version`` (microseconds of the batch, growing by session), of which the last counts. tool_count counts calls begun, tools_used those completed, by tool.

    Timers are of event time: once the watermark (``late`` behind the newest event) passes ``idle_ms`` after a session's
    last event or its end, its state is removed; one that is still active then ends at its last event. So a query that
    takes what is there now ends by itself, and state is bounded by the sessions of the last hours. Events more than
    ``late`` behind may be left out. Write with outputMode update.
    """
    hooks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    hooks = hooks.select("event", "session_id", "tool_name", "timestamp", "input_tokens", "output_tokens", "commit", "arrival")
    timed = hooks.where("session_id is not null and timestamp is not null").withColumn("at", F.timestamp_millis("timestamp")).withWatermark("at", late)
    return timed.groupBy("session_id").transformWithState(SessionProcessor(idle_ms), SESSION, "Update", "EventTime")


def to_table(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to a Parquet table, all that is there now, then stop."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dead_sessions(sessions: DataFrame, live: DataFrame, as_of: int, hour_ms: int = 3_600_000, idle_ms: int = 300_000) -> DataFrame:
    """Active sessions to end: the process is gone, an hour without activity, or five minutes and no live process in the folder."""
    pids = live.select("pid", F.lit(True).alias("pid_live")).distinct()
    folders = live.select("cwd", F.lit(True).alias("cwd_live")).distinct()
    rows = sessions.where("end_time is null").join(pids, "pid", "left").join(folders, "cwd", "left")
    idle = F.lit(as_of) - F.col("last_activity")
    gone = F.col("pid").isNotNull() & F.col("pid_live").isNull()
    return rows.where(gone | (idle > hour_ms) | ((idle > idle_ms) & F.col("cwd_live").isNull())).select("session_id", F.lit(as_of).alias("end_time"))


def stale_managed(managed: DataFrame, live: DataFrame, as_of: int, hour_ms: int = 3_600_000) -> DataFrame:
    """Running managed sessions that failed: a process that is not live, or none and older than an hour."""
    rows = managed.where("status = 'running'").join(live.select("pid", F.lit(True).alias("alive")).distinct(), "pid", "left")
    stale = F.when(F.col("pid").isNotNull(), F.col("alive").isNull()).otherwise(F.lit(as_of) - F.col("started_at") > hour_ms)
    return rows.where(stale).select("id", F.lit("failed").alias("status"), F.lit(-1).alias("exit_code"), F.lit(as_of).alias("ended_at"))


def long_running(calls: DataFrame, as_of: int, threshold_ms: int = 60_000) -> DataFrame:
    """Open Bash calls beyond a threshold."""
    return calls.where(F.col("completed_at").isNull() & (F.col("tool_name") == "Bash") & (F.lit(as_of) - F.col("started_at") > threshold_ms))
