"""Registered queries of readers, sinks and streams: the driver's tables are written in a layout and read back."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import transcripts
from ..operators.ordering import range_numbered
from ..sources import changelog, logs, sinks, zips
from ..sources.shared import fresh_folder
from ..streaming import ingest, live
from . import adapters as on
from .queries import query

MS = "(epoch_us(ts) // 1000)"


def _events(spark, d):
    return on.table(spark, d, "events").withColumn("timestamp", on.millis("ts"))


@query(f"SELECT event_id, event_type, {MS} AS timestamp FROM events")
def jsonl_read(spark, d):
    """JSON lines with a line that is none after each."""
    folder = fresh_folder(spark, "jsonl")
    lines = sinks.json_lines(_events(spark, d).select("event_id", "event_type", "timestamp"))
    lines.select(F.explode(F.array("value", F.lit("{broken"), F.lit(""))).alias("value")).write.text(folder)
    return logs.read_jsonl(spark, folder, "event_id long, event_type string, timestamp long").where("event_id is not null")


@query(f"SELECT event_id, strftime(ts, '%Y-%m-%d') AS dt FROM events WHERE strftime(ts, '%Y-%m-%d') BETWEEN '2024-01-05' AND '2024-01-09'")
def date_partitions(spark, d):
    folder = fresh_folder(spark, "dated")
    sinks.append_log(_events(spark, d).select("event_id", "timestamp"), folder)
    return logs.read_partitioned(spark, folder, "event_id long", "2024-01-05", "2024-01-09").select("event_id", F.date_format(F.col("dt").cast("date"), "yyyy-MM-dd").alias("dt"))


@query(f"""WITH v AS (SELECT user_id AS session_id, event_id AS line, strftime(ts, '%Y-%m-%d') AS dt, {MS} - event_id % 100 * 1000 AS start_time FROM events)
 SELECT session_id, dt, line, start_time FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY dt DESC, line DESC) AS rn FROM v WHERE start_time >= 1704500000000) WHERE rn = 1""")
def session_versions(spark, d):
    log = _events(spark, d).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("line"), F.date_format("ts", "yyyy-MM-dd").alias("dt"), (F.col("timestamp") - F.col("event_id") % 100 * 1000).alias("start_time"))
    return logs.hook_sessions(log, 1_704_500_000_000)


@query(f"SELECT DISTINCT user_id || ':' || event_type AS tool_use_id FROM events WHERE {MS} > 1704500000000")
def recent_usages(spark, d):
    log = _events(spark, d).select(F.concat_ws(":", "user_id", "event_type").alias("tool_use_id"), "timestamp")
    return logs.tool_usages(log, 1_704_500_000_000, dedupe=True).select("tool_use_id")


@query("SELECT 'n' || n_nationkey AS id, n_name AS prompt, n_regionkey * 1000 AS started_at FROM nation WHERE n_regionkey >= 2")
def managed_documents(spark, d):
    """A JSON document for each file."""
    folder = fresh_folder(spark, "managed")
    rows = on.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("prompt"), (F.col("n_regionkey") * 1000).cast("long").alias("started_at"))
    sinks.json_lines(rows).write.option("maxRecordsPerFile", 1).text(folder)
    return logs.managed_sessions(spark, folder, 2000).select("id", "prompt", "started_at")


def _lines(spark, d, make) -> DataFrame:
    c = on.table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("line"), F.to_json(make).alias("value"))


@query("""SELECT conv_id AS transcript_id, turn AS line, 'sum' || conv_id AS name, role, CASE WHEN turn % 2 = 0 THEN text ELSE text || chr(10) || 'more' END AS content, turn * 10 AS input_tokens, CASE WHEN turn % 2 = 1 THEN 'Bash' END AS tool_name FROM conversations""")
def claude_messages(spark, d):
    """Turns as the first vendor's lines: every other content is a list of blocks, and a summary names the transcript."""
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("name")), F.struct(F.lit("text").alias("type"), F.lit("more").alias("text"), F.lit(None).cast("string").alias("name")), F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("Bash").alias("name")))
    usage = F.struct((F.col("turn") * 10).alias("input_tokens"))
    plain = F.struct(F.lit("message").alias("type"), F.struct("role", F.col("text").alias("content"), usage.alias("usage")).alias("message"))
    listed = F.struct(F.lit("message").alias("type"), F.struct("role", block.alias("content"), usage.alias("usage")).alias("message"))
    c = on.table(spark, d, "conversations")
    even = _lines(spark, d, plain).where("line % 2 = 0")
    odd = _lines(spark, d, listed).where("line % 2 = 1")
    names = c.select(F.col("conv_id").alias("transcript_id"), F.lit(-1).cast("long").alias("line"), F.to_json(F.struct(F.lit("summary").alias("type"), F.concat(F.lit("sum"), F.col("conv_id").cast("string")).alias("summary"))).alias("value")).distinct()
    broken = names.select("transcript_id", F.lit(-2).cast("long").alias("line"), F.lit("{no").alias("value"))
    lines = functools.reduce(DataFrame.unionByName, [even, odd, names, broken])
    return logs.parse_claude(lines).select("transcript_id", "line", "name", "role", "content", "input_tokens", "tool_name")


@query("SELECT conv_id AS transcript_id, turn AS line, role, text AS content FROM conversations WHERE turn % 3 <> 0")
def codex_messages(spark, d):
    kind = F.when(F.col("turn") % 3 == 0, "event_msg").otherwise("response_item")
    payload = F.struct(F.lit("message").alias("type"), "role", F.array(F.struct("text")).alias("content"))
    return logs.parse_codex(_lines(spark, d, F.struct(kind.alias("type"), payload.alias("payload")))).select("transcript_id", "line", "role", "content")


@query("SELECT conv_id AS transcript_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS line, CASE WHEN role = 'assistant' THEN 'assistant' ELSE role END AS role, text AS content FROM conversations")
def gemini_messages(spark, d):
    m = F.struct("turn", "role", "text")
    per = on.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("transcript_id")).agg(F.array_sort(F.collect_list(m)).alias("m"))
    messages = F.transform("m", lambda x: F.struct(F.when(x.role == "assistant", "gemini").otherwise(x.role).alias("type"), x.text.alias("content")))
    return logs.parse_gemini(per.select("transcript_id", F.to_json(F.struct(messages.alias("messages"))).alias("value"))).select("transcript_id", "line", "role", "content")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS state, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS version FROM orders")
def json_store(spark, d):
    """A store whose rows are replaced by newer ones of the same key, each of which comes in two versions."""
    o = on.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.lit(0).alias("version"))
    new = o.where("id % 3 = 0").select("id", F.explode(F.array(F.struct(F.lit("newer").alias("state"), F.lit(1).alias("version")), F.struct(F.lit("new").alias("state"), F.lit(2).alias("version")))).alias("v")).select("id", "v.*")
    folder = fresh_folder(spark, "store")
    sinks.json_lines(sinks.upsert(o, new, "id", "version")).write.text(folder)
    return logs.read_jsonl(spark, folder, "id long, state string, version int")


@query("""SELECT 'labels.jsonl' AS name, count(*) AS rows, CAST(sum(length('{"doc_id":' || doc_id || ',"quality":' || quality || '}') + 1) AS BIGINT) AS bytes FROM labels UNION ALL SELECT 'sources.jsonl', count(*), CAST(sum(strlen('{"source":"' || source || '"}') + 1) AS BIGINT) FROM documents""")
def bundle_files(spark, d):
    tables = {"labels": on.table(spark, d, "labels").select("doc_id", "quality"), "sources": on.table(spark, d, "documents").select("source")}
    return sinks.bundle(tables, fresh_folder(spark, "bundle")).select("name", "rows", "bytes")


@query("SELECT CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT count(*) AS rows, sum(length('{\"doc_id\":' || doc_id || ',\"quality\":' || quality || '}') + 1) AS bytes FROM labels UNION ALL SELECT 1, 3)")
def zip_files(spark, d):
    """Members of the ZIP files with the report: rows and bytes of all."""
    made = sinks.zip_bundle({"labels": on.table(spark, d, "labels").select("doc_id", "quality")}, fresh_folder(spark, "zip"))
    return made.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))


@query("SELECT conv_id AS transcript_id, string_agg('## ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn, '## ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || text) AS markdown FROM conversations GROUP BY 1")
def markdown(spark, d):
    m = on.table(spark, d, "conversations").select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("line"), "role", F.col("text").alias("content"))
    return sinks.markdown(m)


@query("SELECT conv_id, turn, CASE WHEN turn % 7 = 0 THEN NULL WHEN turn % 5 = 0 THEN '[Bash] ' || text ELSE role || ': ' || text END AS line FROM conversations WHERE trim(text) <> ''")
def display_lines(spark, d):
    c = on.table(spark, d, "conversations").where("trim(text) <> ''")
    return c.select("conv_id", "turn", sinks.display_line(F.col("role"), F.when(F.col("turn") % 5 == 0, "Bash"), F.when(F.col("turn") % 7 == 0, " ").otherwise(F.col("text"))).alias("line"))


@query("""WITH c AS (SELECT url AS file_path, list_value('Read', 'Write', 'Edit', 'Read')[page_id % 4 + 1] AS tool FROM pages), g AS (SELECT file_path, count(*) FILTER (tool = 'Read') AS reads, count(*) FILTER (tool = 'Write') AS writes, count(*) FILTER (tool = 'Edit') AS edits FROM c GROUP BY 1) SELECT * FROM g ORDER BY reads DESC, file_path LIMIT 20""")
def corpus_files(spark, d):
    calls = on.table(spark, d, "pages").select(F.col("url").alias("file_path"), F.element_at(F.array(*map(F.lit, ["Read", "Write", "Edit", "Read"])), (F.col("page_id") % 4 + 1).cast("int")).alias("tool_name"), F.col("page_id").alias("transcript_id"))
    return transcripts.corpus_stats(calls).drop("transcripts")


@query("SELECT doc_id, quality, 'ok' AS status FROM labels")
def zip_import(spark, d):
    """Labels written as ZIP bundles, read back and held against their manifest."""
    folder = fresh_folder(spark, "zips")
    manifest = sinks.zip_bundle({"labels": on.table(spark, d, "labels").select("doc_id", "quality")}, folder)
    lines, status = zips.import_bundle(spark, folder, manifest)
    rows = lines.where("name like 'labels%'").join(status.select("zip", "name", "status"), ["zip", "name"])
    return rows.select(F.from_json("value", "doc_id long, quality int").alias("j"), "status").select("j.*", "status")


@query("""WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), l AS (SELECT 0 AS kind, '' AS pos, 'manifest' AS type, (SELECT count(*) FROM s) AS n UNION ALL SELECT 1, CAST(user_id AS VARCHAR), 'session', n FROM s UNION ALL SELECT 2, CAST(event_id AS VARCHAR), 'tool_usage', event_id FROM events)
 SELECT CAST(row_number() OVER (ORDER BY kind, pos) AS BIGINT) AS line, type, CAST(n AS BIGINT) AS n FROM l""")
def legacy_bundle(spark, d):
    """Users as sessions and events as usages in one bundle, its lines numbered in the order of its files."""
    e = on.table(spark, d, "events")
    folder = fresh_folder(spark, "legacy")
    sessions = e.groupBy(F.col("user_id").alias("session_id")).agg(F.count("*").alias("n"))
    sinks.legacy_bundle(sessions, e.select(F.col("event_id").alias("tool_use_id"), "event_type"), folder, "b1", "2024-01-31T00:00:00Z", {"email": 2})
    schema = "type string, session_count long, data struct<n:long,tool_use_id:long>"
    rows = spark.read.text(folder).select(F.from_json("value", schema).alias("j"), F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
    numbered = range_numbered(rows, [], ["file", "at"], "line")
    return numbered.select(F.col("line").cast("long").alias("line"), "j.type", F.coalesce("j.session_count", "j.data.n", "j.data.tool_use_id").alias("n"))


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives of all that is there now, in one batch, as a table."""
    folder = fresh_folder(spark, "stream")
    write = lambda batch, _: batch.write.mode("append").parquet(f"{folder}/out")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _hook_stream(spark, rows: DataFrame) -> DataFrame:
    """rows of hook events, dropped as JSON lines and read as a stream."""
    folder = fresh_folder(spark, "hooks")
    rows.write.json(folder)
    return live.read_stream(spark, folder)


@query(f"""SELECT user_id || ':' || event_id AS tool_use_id, {MS} AS started_at, {MS} + CAST(floor(value) AS BIGINT) * 10 AS completed_at, CAST(floor(value) AS BIGINT) * 10 AS duration_ms, event_type <> 'error' AS success FROM events WHERE event_id % 2 = 0""")
def stream_pairs(spark, d):
    """Begins and ends of every other event as a stream, joined."""
    e = _events(spark, d).select(F.concat_ws(":", "user_id", "event_id").alias("tool_use_id"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("tool_name"), "timestamp", F.when(F.col("event_type") == "error", "bad").alias("error"), "event_id", "value")
    pre = e.select(F.lit("pre").alias("event"), "tool_use_id", "session_id", "tool_name", "timestamp", F.lit(None).cast("string").alias("error"))
    post = e.where("event_id % 2 = 0").select(F.lit("post").alias("event"), "tool_use_id", "session_id", "tool_name", (F.col("timestamp") + F.floor("value") * 10).alias("timestamp"), "error")
    out = _drained(spark, live.paired_calls(_hook_stream(spark, pre.unionByName(post)), late="400 days"), "append")
    return out.where("completed_at is not null").select("tool_use_id", "started_at", "completed_at", "duration_ms", "success")


@query("SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS category, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    folder = fresh_folder(spark, "bus")
    _events(spark, d).select(F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("event_type").alias("category")).write.json(folder)
    out = _drained(spark, live.windowed_counts(live.events(spark, folder), "6 hours"), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "category", "n")


@query("SELECT DISTINCT event_id % 1000 AS id FROM events")
def stream_unique(spark, d):
    folder = fresh_folder(spark, "bus")
    _events(spark, d).select((F.col("event_id") % 1000).cast("string").alias("id"), F.lit("2024-01-01T00:00:00").alias("timestamp"), F.lit("c").alias("category")).write.json(folder)
    return _drained(spark, live.unique_events(live.events(spark, folder)), "append").select(F.col("id").cast("long").alias("id"))


@query("SELECT o_orderkey AS session_id FROM orders WHERE o_orderkey % 4 <> 0 AND (o_custkey % 2 = 0 AND o_custkey > 500 OR 10000000 - o_orderkey * 400 > 3600000 OR 10000000 - o_orderkey * 400 > 300000 AND o_custkey % 40 >= 20)")
def dead_sessions(spark, d):
    o = on.table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = o.select(k.alias("session_id"), F.when(k % 4 == 0, 1).alias("end_time"), F.when(c % 2 == 0, c).alias("pid"), (c % 40).cast("string").alias("cwd"), (k * 400).alias("last_activity"))
    running = o.where("o_custkey <= 500 or o_custkey % 2 = 1").select(c.alias("pid")).unionByName(spark.range(1, 501).select(F.col("id").alias("pid"))).distinct()
    on_now = running.crossJoin(F.broadcast(spark.range(20).select(F.col("id").cast("string").alias("cwd"))))  # twenty folders
    return live.dead_sessions(s, on_now, 10_000_000).select("session_id")


@query("SELECT o_orderkey AS id, -1 AS exit_code FROM orders WHERE o_orderstatus = 'O' AND CASE WHEN o_custkey % 2 = 0 THEN o_custkey > 500 ELSE 10000000 - o_orderkey * 400 > 3600000 END")
def stale_managed(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    m = on.table(spark, d, "orders").select(k.alias("id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"), F.when(c % 2 == 0, c).alias("pid"), (k * 400).alias("started_at"))
    return live.stale_managed(m, spark.range(501).select(F.col("id").alias("pid")), 10_000_000).select("id", "exit_code")


@query(f"SELECT event_id FROM events WHERE event_type = 'click' AND event_id % 3 = 0 AND {on.AS_OF} - {MS} > 60000")
def long_running(spark, d):
    e = _events(spark, d)
    calls = e.select("event_id", F.when(F.col("event_type") == "click", "Bash").otherwise("Read").alias("tool_name"), F.when(F.col("event_id") % 3 != 0, 1).alias("completed_at"), F.col("timestamp").alias("started_at"))
    return live.long_running(calls, on.AS_OF).select("event_id")


_KIND = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'pre' WHEN 'view' THEN 'tokens' WHEN 'purchase' THEN 'awaiting' ELSE 'end' END"


@query(f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id, {MS} AS ms, {_KIND} AS event FROM events), w AS (SELECT max(ms) - 3600000 AS mark FROM e),
 s AS (SELECT session_id, max(event_id) AS first FROM e WHERE event = 'start' GROUP BY 1), k AS (SELECT e.*, first FROM e JOIN s USING (session_id) WHERE event_id >= first),
 g AS (SELECT session_id, min(ms) FILTER (event_id = first) AS start_time, arg_max(ms, event_id) FILTER (event = 'end') AS ended, max(ms) FILTER (event <> 'end') AS last_activity, count(*) FILTER (event = 'pre') AS tool_count,
 coalesce(arg_max(event, event_id) FILTER (event IN ('awaiting', 'pre')) = 'awaiting', false) AS awaiting_user, CAST(coalesce(sum(event_id % 97) FILTER (event = 'tokens'), 0) AS BIGINT) AS input_tokens FROM k GROUP BY 1)
 SELECT session_id, CASE WHEN ended IS NOT NULL OR last_activity + 3600000 <= mark THEN 'ended' ELSE 'active' END AS status, start_time, CASE WHEN ended IS NOT NULL THEN ended WHEN last_activity + 3600000 <= mark THEN last_activity END AS end_time,
 last_activity, tool_count, awaiting_user, input_tokens FROM g, w""")
def live_sessions(spark, d):
    """Events in order of their number as hook events of their user's session: the last state of each session."""
    kind = F.expr(_KIND)
    rows = _events(spark, d).select(kind.alias("event"), F.col("user_id").cast("string").alias("session_id"), F.lit("Bash").alias("tool_name"), "timestamp", F.when(kind == "tokens", F.col("event_id") % 97).alias("input_tokens"), F.col("event_id").alias("seq"))
    folder = fresh_folder(spark, "hooks")
    rows.write.json(folder)
    out = _drained(spark, live.live_sessions(live.read_hooks(spark, folder)), "update")
    last = out.groupBy("session_id").agg(F.max_by(F.struct("status", "start_time", "end_time", "last_activity", "tool_count", "awaiting_user", "input_tokens"), "version").alias("s"))
    return last.select("session_id", "s.*")


def _three_batches(spark, rows: DataFrame, part: str):
    """``rows`` in three batches by ``part``, one after the other."""
    for k in range(3):
        yield k, rows.where(F.expr(part) == k).drop("part")


@query("SELECT event_id AS id, event_type AS category FROM events ORDER BY event_id DESC LIMIT 500")
def event_ring(spark, d):
    """The last 500 events by their number, after three batches of which one is replayed."""
    rows = _events(spark, d).select(F.col("event_id").alias("id"), F.col("event_type").alias("category"))
    ring = changelog.Ring(spark, fresh_folder(spark, "ring"), "id long, category string", [F.col("id").desc()])
    for k, batch in _three_batches(spark, rows, "id % 3"):
        ring.append(batch, k)
    ring.append(rows.where("id % 3 = 2"), 2)
    return ring.read()


@query("""WITH c AS (SELECT user_id AS key, event_id AS version, event_type FROM events), l AS (SELECT key, max(version) AS version, arg_max(event_type, version) AS state FROM c GROUP BY 1)
 SELECT key, version, state FROM l WHERE state <> 'error' ORDER BY version DESC LIMIT 200""")
def live_upserts(spark, d):
    """The newest state of each user, deleted by an error; later batches bring older changes; 200 rows are kept."""
    rows = _events(spark, d).select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), (F.col("event_type") == "error").alias("deleted"), F.col("event_type").alias("state"))
    log = changelog.ChangeLog(spark, fresh_folder(spark, "upserts"), "key long, version long, deleted boolean, state string")
    for k, batch in _three_batches(spark, rows, "2 - version % 3"):
        log.append(batch, k)
        if k == 1:
            log.compact()
    return log.read(cap=200).drop("deleted")


_ENDPOINT = "CASE event_type WHEN 'signup' THEN 'session-start' WHEN 'click' THEN 'pre-tool-use' WHEN 'view' THEN 'post-tool-use' WHEN 'purchase' THEN 'session-end' ELSE 'stop' END"


@query(f"""WITH e AS (SELECT event_id, {_ENDPOINT} AS endpoint, event_id % 3 <> 0 AS has_id, event_id % 5 <> 0 AS has_more FROM events)
 SELECT event_id, endpoint, CASE WHEN endpoint = 'stop' THEN NULL WHEN endpoint = 'session-end' THEN CASE WHEN NOT has_id THEN 'missing session_id' END
 ELSE CASE WHEN has_id AND has_more THEN NULL ELSE 'missing ' || concat_ws(', ', CASE WHEN NOT has_id THEN 'session_id' END, CASE WHEN NOT has_more THEN CASE WHEN endpoint = 'session-start' THEN 'cwd' ELSE 'tool_name' END END) END END AS reason FROM e""")
def hook_intake(spark, d):
    """Events as bodies of hook endpoints, of which some lack a required field, taken in by three batches, one replayed."""
    k, kind = F.col("event_id"), F.expr(_ENDPOINT)
    body = F.to_json(F.struct(k.alias("event_id"), F.when(k % 3 != 0, F.col("user_id").cast("string")).alias("session_id"), F.when(k % 5 != 0, "Bash").alias("tool_name"), F.when(k % 5 != 0, "/w").alias("cwd")))
    rows = _events(spark, d).select(k, kind.alias("endpoint"), body.alias("body"))
    intake = ingest.Intake(spark, fresh_folder(spark, "intake"))
    for n, batch in [*_three_batches(spark, rows, "event_id % 3"), (1, rows.where("event_id % 3 = 1"))]:
        intake.append(batch, n)
    number = F.get_json_object("body", "$.event_id").cast("long").alias("event_id")
    return intake.good().select(number, "endpoint", F.lit(None).cast("string").alias("reason")).unionByName(intake.rejected().select(number, "endpoint", "reason"))


@query(f"""WITH b AS (SELECT conv_id, string_agg('## ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1),
 c AS (SELECT conv_id, role, sum(turn) AS n FROM conversations WHERE turn % 3 > 0 GROUP BY 1, 2), s AS (SELECT conv_id, sum(n) AS total, string_agg('- ' || role || ': ' || n, chr(10) ORDER BY role) AS each FROM c GROUP BY 1)
 SELECT conv_id AS transcript_id, body || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Redaction Summary' || chr(10) || chr(10) || '**Total redactions:** ' || coalesce(total, 0) || chr(10) || chr(10)
 || coalesce('**By category:**' || chr(10) || each || chr(10) || chr(10), '') || '{sinks.SANITIZED_NOTE}' || chr(10) AS markdown FROM b LEFT JOIN s USING (conv_id)""")
def markdown_summary(spark, d):
    """Conversations as Markdown; the turns of a role stand for the redactions of a category."""
    c = on.table(spark, d, "conversations")
    messages = c.select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("line"), "role", F.col("text").alias("content"))
    return sinks.markdown(messages, c.where("turn % 3 > 0").select(F.col("conv_id").alias("transcript_id"), F.col("role").alias("category"), F.col("turn").alias("n")))
