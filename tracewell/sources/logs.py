"""Readers of logs and transcripts as typed tables.

All are lazy scans with a fixed schema. Bad lines are left out; a missing folder is an empty table. Date-partitioned
folders (``dt=YYYY-MM-DD``) prune by date before anything is read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import detect_agent, etime_seconds

HOOK_SESSION = "session_id string, transcript_path string, cwd string, start_time long, end_time long, permission_mode string, source string, tool_count long, last_activity long, awaiting_user boolean, tools_used map<string,long>, commits array<string>, pid long, total_input_tokens long, total_output_tokens long, estimated_cost_usd double, auto_continue_attempts long"
TOOL_USAGE = "tool_use_id string, tool_name string, tool_input string, timestamp long, session_id string, cwd string, success boolean, duration_ms long, tool_response string, error string"
MANAGED_SESSION = "id string, prompt string, agent string, pid long, cwd string, started_at long, ended_at long, exit_code long, status string"
EVENT = "id string, timestamp string, category string, action string, entity_id string, description string, details string, source string"
_BLOCKS = "array<struct<type:string,text:string,thinking:string,name:string,input:string>>"
_USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines as rows; blank and invalid lines are left out, a missing path is empty."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_partitioned(spark: SparkSession, path: str, schema: str, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """A folder of ``dt=`` partitions, newest first; start and end bound the partition's date."""
    out = read_jsonl(spark, path, schema + ", dt string" if "dt string" not in schema else schema)
    if start is not None:
        out = out.where(F.col("dt") >= start)
    if end is not None:
        out = out.where(F.col("dt") <= end)
    return out if limit is None else out.orderBy(F.col("dt").desc()).limit(limit)


def read_dated(spark: SparkSession, folder: str, schema: str, prefix: str = "", start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """Files ``{prefix}...YYYY-MM-DD....jsonl`` of a folder, newest first, with ``dt`` out of the file's name.

    The date bounds are tests of the file's path, by which Spark leaves files out before it reads them. A file without
    a date passes every bound.
    """
    base = schema if "dt string" not in schema else schema.replace(", dt string", "")
    try:
        rows = spark.read.schema(base).option("mode", "DROPMALFORMED").option("pathGlobFilter", f"{prefix}*.jsonl").json(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], base + ", dt string")
    date = F.nullif(F.regexp_extract(F.col("_metadata.file_name"), r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit(""))
    if start is not None:
        rows = rows.where(F.coalesce(date >= start, F.lit(True)))
    if end is not None:
        rows = rows.where(F.coalesce(date <= end, F.lit(True)))
    out = rows.select("*", date.alias("dt"))
    return out if limit is None else out.orderBy(F.col("dt").desc()).limit(limit)


def hook_sessions(log: DataFrame, cutoff: int, strict: bool = False) -> DataFrame:
    """The last version of each session that began at ``cutoff`` or later (after it, if strict). log has dt and line."""
    began = F.col("start_time") > cutoff if strict else F.col("start_time") >= cutoff
    w = Window.partitionBy("session_id").orderBy(F.col("dt").desc(), F.col("line").desc())
    return log.where(began).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def tool_usages(log: DataFrame, cutoff: int, dedupe: bool = False) -> DataFrame:
    """Usages since the cutoff; with ``dedupe``, strictly after it and one per tool_use_id."""
    out = log.where(F.col("timestamp") > cutoff if dedupe else F.col("timestamp") >= cutoff)
    return out.dropDuplicates(["tool_use_id"]) if dedupe else out


def managed_sessions(spark: SparkSession, folder: str, cutoff: int) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(MANAGED_SESSION).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder).where(F.col("started_at") >= cutoff)


def _content(raw: Column) -> Column:
    """Text of a content that is a string or a list of blocks with text or thinking."""
    blocks = F.from_json(raw, _BLOCKS)
    joined = F.array_join(F.filter(F.transform(blocks, lambda b: F.coalesce(b.text, b.thinking)), lambda t: t.isNotNull()), "\n")
    return F.when(raw.startswith("["), joined).otherwise(raw)


def parse_claude(lines: DataFrame) -> DataFrame:
    """lines (transcript_id, line, value): messages of the first vendor. Summary lines name the transcript and are left out."""
    schema = f"type string, summary string, message struct<role:string,model:string,content:string,usage:{_USAGE}>, timestamp string, uuid string, parentUuid string, isSidechain boolean, agentId string, toolName string"
    rows = lines.select("transcript_id", "line", F.from_json("value", schema).alias("j")).where("j.type is not null")
    name = Window.partitionBy("transcript_id")
    rows = rows.withColumn("name", F.max_by(F.when(F.col("j.type") == "summary", F.col("j.summary")), F.when(F.col("j.type") == "summary", F.col("line"))).over(name)).where("j.type <> 'summary'")
    tool = F.get(F.filter(F.from_json("j.message.content", _BLOCKS), lambda b: b.type == "tool_use"), 0)
    return rows.select(
        "transcript_id", "line", "name", F.coalesce("j.uuid", F.col("line").cast("string")).alias("message_id"), F.col("j.parentUuid").alias("parent_id"), F.coalesce("j.message.role", F.col("j.type")).alias("role"), _content(F.col("j.message.content")).alias("content"),
        F.col("j.timestamp").alias("timestamp"), F.col("j.message.model").alias("model"), F.coalesce("j.toolName", tool["name"]).alias("tool_name"), tool["input"].alias("tool_input"), F.coalesce("j.isSidechain", F.lit(False)).alias("is_sidechain"),
        F.coalesce("j.message.usage.input_tokens", F.lit(0)).alias("input_tokens"), F.coalesce("j.message.usage.output_tokens", F.lit(0)).alias("output_tokens"), F.coalesce("j.message.usage.cache_creation_input_tokens", F.lit(0)).alias("cache_write_tokens"), F.coalesce("j.message.usage.cache_read_input_tokens", F.lit(0)).alias("cache_read_tokens"),
    )


def parse_codex(lines: DataFrame) -> DataFrame:
    """Messages of the second vendor: only response items that are messages."""
    schema = "timestamp string, type string, payload struct<type:string,role:string,content:array<struct<text:string>>,model:string>"
    rows = lines.select("transcript_id", "line", F.from_json("value", schema).alias("j")).where("j.type = 'response_item' and j.payload.type = 'message'")
    content = F.array_join(F.filter(F.transform("j.payload.content", lambda c: c.text), lambda t: t.isNotNull()), "\n")
    return rows.select("transcript_id", "line", F.col("line").cast("string").alias("message_id"), F.col("j.payload.role").alias("role"), content.alias("content"), F.col("j.timestamp").alias("timestamp"), F.col("j.payload.model").alias("model"))


def parse_gemini(documents: DataFrame) -> DataFrame:
    """documents (transcript_id, value): messages of the third vendor; a message with thoughts has the subtype thinking."""
    schema = "messages array<struct<id:string,type:string,content:string,timestamp:string,thoughts:string>>"
    rows = documents.select("transcript_id", F.from_json("value", schema).alias("j")).select("transcript_id", F.posexplode("j.messages").alias("line", "m"))
    return rows.select("transcript_id", "line", F.coalesce("m.id", F.col("line").cast("string")).alias("message_id"), F.when(F.col("m.type") == "gemini", "assistant").otherwise(F.col("m.type")).alias("role"), F.col("m.content").alias("content"), F.col("m.timestamp").alias("timestamp"), F.when(F.col("m.thoughts").isNotNull(), "thinking").alias("subtype"))


def catalog(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """Transcript files: id, agent, path, size, modified_at, exact and estimated number of messages."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder).select("*", "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    per = files.groupBy("file_path", "file_size", "file_modification_time").agg(F.count(F.when(F.trim("value") != "", 1)).alias("message_count"))
    name = F.regexp_extract("file_path", r"([^/]+?)(\.jsonl?)?$", 1)
    agent = F.coalesce(detect_agent(F.col("file_path")), F.lit("claude"))
    return per.select(F.concat(agent, F.lit(":"), name).alias("id"), agent.alias("agent"), F.col("file_path").alias("path"), F.col("file_size").alias("size_bytes"), F.unix_millis("file_modification_time").alias("modified_at"), "message_count", F.floor(F.col("file_size") / 800 + 0.5).alias("estimated_message_count"))


def _millis_of(value: Column) -> Column:
    """Epoch milliseconds of a JSON line's time: a number is seconds, a text a date."""
    raw = F.coalesce(F.get_json_object(value, "$.timestamp"), F.get_json_object(value, "$.ts"))
    return F.coalesce((F.try_to_number(raw, F.lit("9999999999999")) * 1000).cast("long"), F.unix_millis(F.try_to_timestamp(raw)))


def _files(spark: SparkSession, folder: str, pattern: str, whole: bool = False) -> DataFrame:
    """value (a line, or a whole file), path, size_bytes, modified_at, file_name without its ending, at (order of lines)."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("wholetext", whole).text(folder)
    m = F.col("_metadata")
    return rows.select("value", m.file_path.alias("path"), m.file_size.alias("size_bytes"), F.unix_millis(m.file_modification_time).alias("modified_at"), F.regexp_replace(m.file_name, r"\.jsonl?$", "").alias("file_name"), F.struct(m.file_block_start.alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"))


def _per_file(lines: DataFrame) -> DataFrame:
    t = _millis_of(F.col("value"))
    summary = F.when(F.get_json_object("value", "$.type") == "summary", F.substring(F.get_json_object("value", "$.summary"), 1, 50))
    return lines.groupBy("path", "file_name", "size_bytes", "modified_at").agg(F.min(t).alias("start_time"), F.max(t).alias("end_time"), F.max_by(summary, F.when(summary.isNotNull(), F.col("at"))).alias("summary")).withColumn("message_count", F.nullif(F.floor(F.col("size_bytes") / 800 + 0.5), F.lit(0)))


_META = ["id", "agent", "path", "name", "project_dir", "modified_at", "size_bytes", "message_count", "start_time", "end_time"]


def claude_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts ``{project}/{session}.jsonl``: named by their last summary, else by the project's folder, which is
    its path with dashes; times over all lines; the number of messages is an estimate by size."""
    per = _per_file(_files(spark, folder, "*.jsonl"))
    parent = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    project = F.when(parent.startswith("-"), F.translate(parent, "-", "/"))
    name = F.coalesce("summary", F.regexp_extract(project, r"([^/]*)/*$", 1), F.col("file_name"))
    return per.select(F.concat(F.lit("claude:"), "file_name").alias("id"), F.lit("claude").alias("agent"), "path", name.alias("name"), project.alias("project_dir"), *_META[5:])


def codex_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts ``sessions/YYYY/MM/DD/rollout-{time}-....jsonl``: project and name are the date and time of the path."""
    per = _per_file(_files(spark, folder, "*.jsonl"))
    day = F.regexp_extract_all("path", F.lit(r"/sessions/([^/]+)/([^/]+)/([^/]+)/"), F.lit(0))
    project = F.when(F.size(day) > 0, F.regexp_replace(day[0], r"^/sessions/([^/]+)/([^/]+)/([^/]+)/$", "$1-$2-$3"))
    stamp = F.nullif(F.regexp_extract("file_name", r"rollout-(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2})", 1), F.lit(""))
    name = F.coalesce(F.translate(stamp, "-T", ": "), "file_name")
    return per.select(F.concat(F.lit("codex:"), "file_name").alias("id"), F.lit("codex").alias("agent"), "path", name.alias("name"), project.alias("project_dir"), *_META[5:])


def gemini_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Whole JSON files ``{project hash}/chats/{session}.json``: messages counted, named by the first of the user."""
    schema = "startTime string, lastUpdated string, messages array<struct<type:string,content:string,timestamp:string>>"
    rows = _files(spark, folder, "*.json", whole=True).withColumn("j", F.from_json("value", schema)).where("j is not null")
    project = F.coalesce(F.nullif(F.regexp_extract("path", r"([^/]+)/chats/[^/]+$", 1), F.lit("")), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    millis = lambda c: F.unix_millis(F.try_to_timestamp(c))
    times = F.transform("j.messages", lambda m: millis(m.timestamp))
    first = F.get(F.filter("j.messages", lambda m: m.type == "user"), F.lit(0))
    return rows.select(
        F.concat(F.lit("gemini:"), project, F.lit(":"), "file_name").alias("id"), F.lit("gemini").alias("agent"), "path", F.coalesce(F.nullif(F.substring(first["content"], 1, 50), F.lit("")), "file_name").alias("name"), F.concat(F.lit("gemini:"), F.substring(project, 1, 12)).alias("project_dir"),
        "modified_at", "size_bytes", F.nullif(F.coalesce(F.size("j.messages"), F.lit(0)).cast("long"), F.lit(0)).alias("message_count"), F.coalesce(millis(F.col("j.startTime")), F.array_min(times)).alias("start_time"), F.coalesce(millis(F.col("j.lastUpdated")), F.array_max(times)).alias("end_time"),
    )


def discover(*catalogs: DataFrame, since: int | None = None, limit: int | None = None) -> DataFrame:
    """Catalogs of several agents in one, newest first."""
    out = catalogs[0]
    for c in catalogs[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    if since is not None:
        out = out.where(F.col("modified_at") >= since)
    out = out.orderBy(F.col("modified_at").desc(), "id")
    return out if limit is None else out.limit(limit)


def session_log_name(path: Column) -> list[Column]:
    """started_at, pid and label out of ``{ts}_{pid}_{label}.jsonl``."""
    part = lambda i: F.nullif(F.regexp_extract(path, r"([0-9TZ:.-]+)_(\d+)_([^/]+)\.jsonl$", i), F.lit(""))
    return [part(1).alias("started_at"), part(2).cast("long").alias("pid"), part(3).alias("label")]


def parse_git_status(lines: DataFrame) -> DataFrame:
    """lines (repo_id, value) of porcelain status: staged, unstaged, untracked, conflicts; branch, ahead, behind."""
    x, y, head = F.substring("value", 1, 1), F.substring("value", 2, 1), F.col("value").startswith("##")
    clash = F.substring("value", 1, 2).isin("UU", "AA", "DD", "AU", "UA", "DU", "UD")
    new = F.col("value").startswith("??")
    number = lambda p: F.max(F.when(head, F.coalesce(F.nullif(F.regexp_extract("value", p, 1), F.lit("")).cast("long"), F.lit(0))))
    count = lambda c: F.count(F.when(~head & c, 1))
    return lines.groupBy("repo_id").agg(
        count(~new & ~clash & (x != " ")).alias("staged"), count(~new & ~clash & (y != " ")).alias("unstaged"), count(new).alias("untracked"), count(clash).alias("conflicts"),
        F.max(F.when(head, F.regexp_extract("value", r"^## (?:No commits yet on )?(\S+?)(?:\.\.\.|\s|$)", 1))).alias("branch"), number(r"ahead (\d+)").alias("ahead"), number(r"behind (\d+)").alias("behind"),
    )


def parse_ports(lines: DataFrame, low: int = 1024, high: int = 65_535) -> DataFrame:
    """Listening sockets out of lsof lines (value): process_name, pid, bind_address, port."""
    p = r"^(\S+)\s+(\d+)\s.*\sTCP\s+(\S+):(\d+)\s+\(LISTEN\)"
    part = lambda i: F.regexp_extract("value", p, i)
    return lines.where(F.col("value").rlike(p)).select(part(1).alias("process_name"), part(2).cast("long").alias("pid"), part(3).alias("bind_address"), part(4).cast("int").alias("port")).where(F.col("port").between(low, high))


def parse_ps(lines: DataFrame, threads: bool = True) -> DataFrame:
    """Processes out of ps lines (value) with the columns pid, ppid, tty, comm, etime, pcpu, rss, threads (if there), args."""
    parts = F.split(F.trim("value"), r"\s+")
    fixed = 8 if threads else 7
    number = lambda i, kind: F.regexp_extract(parts[i], r"^([0-9]+\.?[0-9]*)", 1).try_cast(kind)
    tty = F.when(~parts[2].isin("?", "??"), parts[2])
    rows = lines.where((F.size(parts) >= fixed + 1) & number(0, "long").isNotNull())
    return rows.select(
        number(0, "long").alias("pid"), F.coalesce(number(1, "long"), F.lit(1)).alias("ppid"), tty.alias("tty"), parts[3].alias("exe"), F.array_join(F.slice(parts, fixed + 1, F.size(parts)), " ").alias("cmdline"),
        etime_seconds(parts[4]).alias("etime_seconds"), F.coalesce(number(5, "double"), F.lit(0.0)).alias("cpu_pct"), number(6, "long").alias("rss_kb"), (F.nullif(number(7, "long"), F.lit(0)) if threads else F.lit(None).cast("long")).alias("threads"),
    )
