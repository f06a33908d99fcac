"""Costs, privacy risk, tool results, diffs, previews and source types of transcripts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import sensitive_reason


def model_price(model: Column) -> Column:
    """(input, output) dollars per million tokens; a date at the end of the name does not count."""
    name = F.regexp_replace(model, r"-[0-9]{8}\z", "")
    price = lambda p: F.struct(F.lit(p[0]).alias("input"), F.lit(p[1]).alias("output"))
    exact = [F.when(name == n, price(p)) for n, *p in rules.MODEL_PRICES]
    near = [F.when(name.contains(n) | F.lit(n).contains(name), price(p)) for n, *p in rules.MODEL_PRICES]
    return F.coalesce(*exact, *near, price(rules.DEFAULT_PRICE))


def cost_by_model(messages: DataFrame) -> DataFrame:
    """Per transcript and model: four token sums, messages, dollars; cached tokens at a quarter of the input price."""
    sums = {c: F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens")}
    per = messages.where("model is not null").groupBy("transcript_id", "model").agg(*sums.values(), F.count("*").alias("message_count")).withColumn("price", model_price(F.col("model")))
    cached = F.col("cache_write_tokens") + F.col("cache_read_tokens")
    cost = F.col("input_tokens") / 1e6 * F.col("price.input") + F.col("output_tokens") / 1e6 * F.col("price.output") + cached / 1e6 * F.col("price.input") * rules.CACHE_SHARE
    return per.withColumn("cost", cost).drop("price")


def session_cost(by_model: DataFrame) -> DataFrame:
    return by_model.groupBy("transcript_id").agg(*[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_write_tokens", "cache_read_tokens", "message_count", "cost")])


def privacy_risk(calls: DataFrame) -> DataFrame:
    """calls (transcript_id, line, tool_name, file_path, url): distinct files and domains, sensitive reads (each counts), level."""
    file_of = lambda tool: F.countDistinct(F.when(F.col("tool_name") == tool, F.col("file_path")))
    sensitive = F.when(F.col("tool_name") == "Read", sensitive_reason(F.col("file_path")))
    per = calls.groupBy("transcript_id").agg(
        file_of("Read").alias("files_read"), file_of("Write").alias("files_written"), file_of("Edit").alias("files_edited"),
        F.countDistinct(F.when(F.col("tool_name") == "WebFetch", F.try_parse_url(F.col("url"), F.lit("HOST")))).alias("domains"), F.count(sensitive).alias("sensitive_files"), F.count("*").alias("calls"),
    )
    return per.withColumn("risk_level", F.when(F.col("sensitive_files") > 0, "high").when((F.col("files_read") > 20) | (F.col("domains") > 5), "medium").otherwise("low"))


def corpus_stats(calls: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` files most read, with reads, writes and edits; over all transcripts."""
    tool = lambda t: F.count(F.when(F.col("tool_name") == t, 1))
    per = calls.where("file_path is not null").groupBy("file_path").agg(tool("Read").alias("reads"), tool("Write").alias("writes"), tool("Edit").alias("edits"), F.approx_count_distinct("transcript_id").alias("transcripts"))
    return per.orderBy(F.col("reads").desc(), "file_path").limit(n)


def corpus_totals(catalog: DataFrame, calls: DataFrame) -> DataFrame:
    """One row over all transcripts: their number, bytes and megabytes, and reads (with a file), writes and edits."""
    size = catalog.agg(F.count("*").alias("transcripts"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))
    tool = lambda t, more=F.lit(True): F.count(F.when((F.col("tool_name") == t) & more, 1))
    use = calls.agg(tool("Read", F.col("file_path") != "").alias("reads"), tool("Write").alias("writes"), tool("Edit").alias("edits"))
    return size.withColumn("size_mb", F.floor(F.col("size_bytes") / 1_048_576 + 0.5)).crossJoin(F.broadcast(use))  # one row each


def top_projects(catalog: DataFrame, calls: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` projects of most bytes: the last part of the folder, transcripts, bytes and reads (with a file)."""
    reads = calls.where("tool_name = 'Read' and file_path <> ''").groupBy("transcript_id").agg(F.count("*").alias("reads"))
    name = F.coalesce(F.nullif(F.regexp_extract("project_dir", "([^/]+)$", 1), F.lit("")), F.lit("unknown"))
    per = catalog.join(reads.withColumnRenamed("transcript_id", "id"), "id", "left").groupBy(name.alias("project"))
    return per.agg(F.count("*").alias("transcripts"), F.sum("size_bytes").alias("size_bytes"), F.coalesce(F.sum("reads"), F.lit(0)).alias("reads")).orderBy(F.col("size_bytes").desc(), "project").limit(n)


def sensitive_files(calls: DataFrame, ids: int = 5) -> DataFrame:
    """Sensitive files read: reason, number of transcripts and the first ``ids`` of them."""
    hits = calls.where("tool_name = 'Read'").select("transcript_id", "file_path", sensitive_reason(F.col("file_path")).alias("reason")).where("reason is not null").distinct()
    ranked = hits.withColumn("rn", F.row_number().over(Window.partitionBy("file_path").orderBy("transcript_id")))
    return ranked.groupBy("file_path", "reason").agg(F.count("*").alias("transcripts"), F.array_sort(F.collect_list(F.when(F.col("rn") <= ids, F.col("transcript_id")))).alias("first_ids"))


def result_success(result: Column) -> Column:
    """Success out of a tool's result: an object's error or success, else error words in a text; null without a result."""
    error, success = F.get_json_object(result, "$.error"), F.get_json_object(result, "$.success")
    is_object = F.trim(result).startswith("{")
    of_object = F.when(error.isNotNull() & ~error.isin("", "false", "0"), False).when(success.isNotNull(), ~success.isin("false", "0", "")).otherwise(True)
    return F.when(result.isNull(), None).when(is_object, of_object).otherwise(~result.rlike(rules.TOOL_ERROR_WORDS))


def to_usages(messages: DataFrame) -> DataFrame:
    """Tool messages of transcripts as tool usages; success by ``result_success`` of the result."""
    m = messages.where("tool_name is not null")
    return m.select(F.col("transcript_id").alias("session_id"), F.col("line").alias("pos"), F.col("message_id").alias("tool_use_id"), "tool_name", "tool_input", F.unix_millis(F.try_to_timestamp("timestamp")).alias("timestamp"), result_success(F.col("tool_result")).alias("success"))


def to_sessions(messages: DataFrame) -> DataFrame:
    """Transcripts as sessions: first and last time; the last message's time is the last activity."""
    at = F.unix_millis(F.try_to_timestamp("timestamp"))
    return messages.withColumn("at", at).groupBy(F.col("transcript_id").alias("session_id")).agg(F.min("at").alias("start_time"), F.max("at").alias("end_time"), F.max_by("at", F.when(F.col("at").isNotNull(), F.col("line"))).alias("last_activity"), F.count("tool_name").alias("tool_count"))


def parse_numstat(lines: DataFrame) -> DataFrame:
    """lines (repo_id, value) of numstat output: path, insertions, deletions (binary files 0), status."""
    parts = F.split("value", "\t", 3)
    number = lambda i: F.coalesce(F.nullif(F.regexp_extract(parts[i], r"^([0-9]+)", 1), F.lit("")).cast("long"), F.lit(0))
    rows = lines.where(F.size(parts) >= 3).select("repo_id", parts[2].alias("path"), number(0).alias("insertions"), number(1).alias("deletions"))
    i, d = F.col("insertions"), F.col("deletions")
    return rows.withColumn("status", F.when((i > 0) & (d == 0), "added").when((i == 0) & (d > 0), "deleted").otherwise("modified"))


def diff_summary(changes: DataFrame) -> DataFrame:
    has = lambda s: F.count(F.when(F.col("status") == s, 1))
    return changes.groupBy("repo_id").agg(F.count("*").alias("files_changed"), F.sum("insertions").alias("lines_added"), F.sum("deletions").alias("lines_removed"), has("added").alias("files_created"), has("deleted").alias("files_deleted"))


def top_changes(changes: DataFrame, n: int = 50) -> DataFrame:
    churn = F.col("insertions") + F.col("deletions")
    return changes.withColumn("rn", F.row_number().over(Window.partitionBy("repo_id").orderBy(churn.desc(), "path"))).where(F.col("rn") <= n).drop("rn")


def source_type(source: Column, data: Column) -> Column:
    """What a shared session is, by its JSON's structure, else by its source's name."""
    keys = F.when(F.trim(data).startswith("{"), F.json_object_keys(data))
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    at = lambda p: F.get_json_object(data, p).isNotNull()
    named = F.lower(source)
    return (
        F.when(has("session") & has("tool_usages"), "cc_hook").when(has("tool_name") | has("tool_count") | has("tools_used"), "cc_hook").when(has("messages") & F.get_json_object(data, "$.messages").startswith("["), "cc_transcript")
        .when(at("$.message.model") | at("$.message.usage"), "cc_transcript").when(at("$[0].message"), "cc_transcript").when(at("$[0].tool_name"), "cc_hook")
        .when(named == "claude", "cc_transcript").when(named.isin("codex", "gemini", "opencode"), F.concat(named, F.lit("_transcript"))).when(source == "", "unknown").otherwise(F.coalesce(source, F.lit("unknown")))
    )


def safe_preview(text: Column, most: int = 200) -> Column:
    """A text on one line, cut to a length."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


# The marks of roles in chat previews; other roles have the last.
ROLE_MARKS = {"user": "👤", "assistant": "🤖", "tool": "🔧"}
OTHER_MARK = "📝"


def chat_previews(messages: DataFrame, first: int = 20, cut: int = 200, most: int = 4_000) -> DataFrame:
    """transcript_id, preview: the first messages (line, role, content, timestamp) of each transcript as a chat.

    A message has a line with its role's mark, role and time (UTC, hours and minutes), one with the beginning of its
    content if it has any, and a blank one; then the number of messages left out. Only the first messages of each task's
    rows are shuffled; the number of all comes from a count.
    """
    ranked = messages.withColumn("_k", F.row_number().over(Window.partitionBy("transcript_id").orderBy("line"))).where(F.col("_k") <= first)
    role = F.coalesce(F.nullif("role", F.lit("")), F.lit("unknown"))
    mark = F.coalesce(*[F.when(role == r, F.lit(m)) for r, m in ROLE_MARKS.items()], F.lit(OTHER_MARK))
    content = F.coalesce("content", F.lit(""))
    said = F.trim(F.replace(F.substring(content, 1, cut), F.lit("\n"), F.lit(" ")))
    time = F.coalesce(F.date_format(F.try_to_timestamp("timestamp"), "HH:mm"), F.lit(""))
    head = F.concat(mark, F.upper(F.substring(role, 1, 1)), F.substring(role, 2, 1_000), F.lit(" "), time)
    block = F.concat(head, F.when(said != "", F.concat(F.lit("\n  "), said, F.when(F.length(content) > cut, "...").otherwise(""))).otherwise(""), F.lit("\n"))
    shown = ranked.groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("_k", block.alias("block")))).alias("blocks"))
    counted = messages.groupBy("transcript_id").agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > first, F.concat(F.lit("\n... and "), (F.col("n") - first).cast("string"), F.lit(" more messages"))).otherwise("")
    return shown.join(counted, "transcript_id").select("transcript_id", F.substring(F.concat(F.array_join(F.transform("blocks", lambda b: b.block), "\n"), more), 1, most).alias("preview"))


def check_pattern(pattern: str) -> list[str]:
    """What is wrong with a redaction pattern: it does not compile, nests repeats, or matches nothing at all."""
    try:
        compiled = re.compile(pattern)
    except re.error as e:
        return [f"does not compile: {e}"]
    found = []
    if re.search(r"\([^()]*[+*][^()]*\)[+*{]", pattern):
        found.append("nested repeats can backtrack without end")
    if compiled.match(""):
        found.append("matches the empty text")
    return found


def pattern_matches(rows: DataFrame, patterns: dict[str, str | list[str]], key: str = "id", text: str = "text") -> DataFrame:
    """key, pattern, start, end, match: all matches of named patterns with their places (code points, end exclusive).

    A pattern may have several expressions; a match that two of them find at one place counts once.
    """

    @F.pandas_udf("array<struct<pattern:string,start:int,end:int,match:string>>")
    def run(texts: pd.Series) -> pd.Series:
        table = [(n, [re.compile(x) for x in ([p] if isinstance(p, str) else p)]) for n, p in patterns.items()]
        return pd.Series([[{"pattern": n, "start": a, "end": b, "match": (t or "")[a:b]} for n, several in table for a, b in dict.fromkeys(m.span() for p in several for m in p.finditer(t or ""))] for t in texts])

    return rows.select(key, F.explode(run(F.col(text))).alias("m")).select(key, "m.*")


def merged_spans(matches: DataFrame, key: str = "id") -> DataFrame:
    """(key, start, end): the union of each text's spans, empty ones left out; spans that overlap become one, spans that
    only touch stay two."""
    by_place = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    rows = matches.where("end > start").select(key, "start", "end").distinct().withColumn("first", (F.col("start") >= F.coalesce(before, F.lit(0))).cast("int"))
    return rows.withColumn("k", F.sum("first").over(by_place)).groupBy(key, "k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("k")


def highlight(rows: DataFrame, matches: DataFrame, key: str = "id", text: str = "text", begin: str = ">>>", finish: str = "<<<") -> DataFrame:
    """(key, highlighted): the text of each row with markers around the union of its spans. Keys are unique."""
    spans = merged_spans(matches, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    both = rows.select(key, F.col(text).alias("_text")).join(spans, key, "left")
    piece = lambda a, b: F.substring("_text", a + 1, b - a)
    last = lambda i: F.when(i == 0, 0).otherwise(F.get("spans", i - 1)["end"])
    marked = F.array_join(F.transform("spans", lambda s, i: F.concat(piece(last(i), s["start"]), F.lit(begin), piece(s["start"], s["end"]), F.lit(finish))), "")
    rest = piece(F.element_at("spans", -1)["end"], F.length("_text"))
    return both.select(key, F.when(F.col("spans").isNull(), F.col("_text")).otherwise(F.concat(marked, rest)).alias("highlighted"))
