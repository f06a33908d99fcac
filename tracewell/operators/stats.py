"""Aggregations over tool usages, sessions, events and transcripts.

Usages: session_id, pos, tool_use_id, tool_name, tool_input, timestamp and completed_at (epoch ms), success (null while
open), duration_ms. Every aggregate is a plain groupBy with map-side partial sums; no list of a whole group is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.js import day, half_up, is_false, is_true, share_percent
from .joins import first_prefix
from .ordering import range_totals, running_sums


def n_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def tool_stats(usages: DataFrame) -> DataFrame:
    """Per tool, over completed calls: counts, mean duration, start of the call completed last."""
    done = usages.where("success is not null")
    return done.groupBy("tool_name").agg(
        F.count("*").alias("total_calls"), n_if(F.col("success")).alias("success_count"), n_if(~F.col("success")).alias("failure_count"),
        F.avg("duration_ms").alias("avg_duration_ms"), F.max_by("timestamp", F.struct("completed_at", "pos")).alias("last_used"),
    )


def daily_stats(usages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per UTC day: sessions started, calls completed, calls per tool as a map; a day with either is a row."""
    started = sessions.groupBy(day(F.col("start_time")).alias("date")).agg(F.count("*").alias("session_count"))
    per_tool = usages.where("success is not null").groupBy(day(F.col("completed_at")).alias("date"), "tool_name").agg(F.count("*").alias("n"))
    calls = per_tool.groupBy("date").agg(F.sum("n").alias("tool_calls"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool_name", "n")))).alias("tools_breakdown"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return started.join(calls, "date", "full").select("date", zero("session_count"), zero("tool_calls"), F.coalesce("tools_breakdown", F.create_map().cast("map<string,bigint>")).alias("tools_breakdown"), F.lit(0).cast("long").alias("active_minutes"))


def session_rollup(usages: DataFrame) -> DataFrame:
    """Per session: calls, calls per tool as a map, first and last activity."""
    per_tool = usages.groupBy("session_id", "tool_name").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max(F.coalesce("completed_at", "timestamp")).alias("last"))
    return per_tool.groupBy("session_id").agg(F.sum("n").alias("tool_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool_name", "n")))).alias("tools_used"), F.min("first").alias("start_time"), F.max("last").alias("last_activity"))


def as_text(counts: Column) -> Column:
    """A map of counts as text, k=v joined by commas in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",")


def audit_stats(events: DataFrame) -> DataFrame:
    """Total, per category and per action in one pass of grouping sets, with the oldest and newest time of each."""
    return events.groupingSets([["category"], ["action"], []], "category", "action").agg(F.count("*").alias("n"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"))


def summarize_messages(messages: DataFrame) -> DataFrame:
    """Per transcript: messages by kind, each counted once: side chain, tool, user, assistant."""
    side, tool = is_true(F.col("is_sidechain")), F.col("tool_name").isNotNull()
    kind = F.when(side, "sidechain").when(tool, "tool").otherwise(F.col("role"))
    return messages.withColumn("kind", kind).groupBy("transcript_id").agg(
        F.count("*").alias("message_count"), n_if(F.col("kind") == "user").alias("user_count"), n_if(F.col("kind") == "assistant").alias("assistant_count"),
        n_if(F.col("kind") == "tool").alias("tool_count"), n_if(F.col("kind") == "sidechain").alias("sidechain_count"),
    )


def entry_types(entries: DataFrame) -> DataFrame:
    """Per session: entries by type as a map, and the most frequent type (the first by name among equals)."""
    per = entries.groupBy("session_id", "type").agg(F.count("*").alias("n"))
    return per.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"), F.min(F.struct((-F.col("n")).alias("k"), F.col("type"))).alias("top")).select("session_id", "types", F.col("top.type").alias("primary_type"))


def daily_trend(scored: DataFrame, days: int, as_of: int) -> DataFrame:
    """scored (modified_at ms, score or null): per UTC day of the last ``days``: total, success (60 up), failure (under 40), rate."""
    recent = scored.where(F.col("modified_at") >= as_of - days * 86_400_000)
    per = recent.groupBy(day(F.col("modified_at")).alias("date")).agg(F.count("*").alias("total"), n_if(F.col("score") >= 60).alias("success"), n_if(F.col("score") < 40).alias("failure"))
    return per.withColumn("success_rate", share_percent(F.col("success"), F.col("total")))


def quality_histogram(scored: DataFrame) -> DataFrame:
    """Four buckets of scores with counts and percentages; empty buckets are rows too."""
    spark = scored.sparkSession
    buckets = spark.createDataFrame(rules.QUALITY_BUCKETS, "range string, low int, high int")
    bucket = F.when(F.col("score") < 25, "0-25").when(F.col("score") < 50, "25-50").when(F.col("score") < 75, "50-75").when(F.col("score") <= 100, "75-100")
    counts = scored.where("score is not null").groupBy(bucket.alias("range")).agg(F.count("*").alias("n"))
    joined = buckets.join(counts, "range", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    total = F.sum("n").over(Window.partitionBy())  # four rows
    return joined.select("range", F.col("n").alias("count"), share_percent(F.col("n"), total).alias("percentage"))


def index_percentiles(values: DataFrame, column: str, shares=(0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """sorted[floor(n * p)] for each p, 0 for no values: one row.

    Values are counted first and ranked by running counts over ranges of values.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("k"))
    ranked = range_totals(counts, [], ["v"], F.col("k"), "upto").crossJoin(F.broadcast(values.agg(F.count(column).alias("n"))))  # one row
    return ranked.agg(*[F.coalesce(F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("v"))), F.lit(0)).alias(f"p{round(p * 100)}") for p in shares])


def index_stats(catalog: DataFrame) -> DataFrame:
    """Transcripts by agent, and in all under a null agent."""
    return catalog.groupBy("agent").agg(F.count("*").alias("n")).unionByName(catalog.agg(F.lit(None).cast("string").alias("agent"), F.count("*").alias("n")))


def preparation_stats(prepared: DataFrame) -> DataFrame:
    """prepared (score, redactions, stripped_fields): sessions, redactions, distinct fields stripped, mean score."""
    fields = prepared.select(F.explode("stripped_fields").alias("field")).agg(F.countDistinct("field").alias("fields_stripped"))
    rows = prepared.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("redactions"), F.lit(0)).alias("redactions"), F.coalesce(half_up(F.avg("score"), 1), F.lit(0.0)).alias("mean_score"))
    return rows.crossJoin(F.broadcast(fields))  # one row each


def overview(scored: DataFrame) -> DataFrame:
    """One row: totals, feedback counts, scores by class; a score of 0 is poor, none is unscored."""
    s = F.col("score")
    return scored.agg(
        F.count("*").alias("total"), n_if(F.col("feedback") == "positive").alias("positive"), n_if(F.col("feedback") == "negative").alias("negative"), n_if(F.col("feedback").isNull()).alias("unlabeled"),
        n_if(s >= 80).alias("excellent"), n_if((s >= 60) & (s < 80)).alias("good"), n_if((s >= 40) & (s < 60)).alias("fair"), n_if(s < 40).alias("poor"), n_if(s.isNull()).alias("unscored"),
    )


def annotation_stats(scored: DataFrame) -> DataFrame:
    """Feedback counts and heuristic classes; without a class a row is uncertain."""
    c = F.coalesce(F.col("heuristic"), F.lit("uncertain"))
    return scored.agg(
        F.count("*").alias("total"), n_if(F.col("feedback") == "positive").alias("positive"), n_if(F.col("feedback") == "negative").alias("negative"), n_if(F.col("feedback").isNull()).alias("unlabeled"),
        n_if(c == "likely_success").alias("likely_success"), n_if(c == "likely_failure").alias("likely_failure"), n_if(c == "uncertain").alias("uncertain"),
    )


def workflow_stats(rows: DataFrame) -> DataFrame:
    """Rows by workflow status; none is pending."""
    return rows.groupBy(F.coalesce("workflow_status", F.lit("pending")).alias("workflow_status")).agg(F.count("*").alias("n"))


def recent_activity(usages: DataFrame, as_of: int, window_ms: int = 3_600_000) -> DataFrame:
    """One row over the last window: calls, failures, top tool (the first by name among equals)."""
    recent = usages.where((F.col("timestamp") > as_of - window_ms) & (F.col("timestamp") <= as_of))
    per = recent.groupBy("tool_name").agg(F.count("*").alias("n"), n_if(is_false(F.col("success"))).alias("f"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tool_calls"), F.coalesce(F.sum("f"), F.lit(0)).alias("failures"), F.min(F.struct((-F.col("n")).alias("k"), "tool_name")).getField("tool_name").alias("top_tool"))


def recent_sessions(sessions: DataFrame, as_of: int, window_ms: int = 3_600_000) -> DataFrame:
    """One row over the sessions (start_time, end_time, tokens, cost) that began in the last window or are active."""
    began = (F.col("start_time") > as_of - window_ms) & (F.col("start_time") <= as_of)
    active = (F.col("start_time") <= as_of) & (F.col("end_time").isNull() | (F.col("end_time") > as_of))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return sessions.where(began | active).agg(F.count("*").alias("sessions"), F.count(F.when(active, 1)).alias("active_sessions"), total("input_tokens"), total("output_tokens"), total("cost_usd"))


def active_sessions(sessions: DataFrame) -> DataFrame:
    """(at, active, input_tokens, output_tokens, cost_usd): how many sessions are active from each time on, and what
    those that have begun until then hold, at every time at which one begins or ends.

    A sweep: a session adds one at its start and takes it away at its end (never, if it has none). Changes of one time
    are added up, dealt to ranges of time, and each range starts from the sum of those before it, so no task sees all.
    """
    parts = ["input_tokens", "output_tokens", "cost_usd"]
    begin = sessions.select(F.col("start_time").alias("at"), F.lit(1).alias("change"), *parts)
    finish = sessions.where("end_time is not null").select(F.greatest("end_time", "start_time").alias("at"), F.lit(-1).alias("change"), *[F.lit(0).alias(c) for c in parts])
    changes = begin.unionByName(finish).where("at is not null").groupBy("at").agg(*[F.sum(c).alias(c) for c in ["change", *parts]])
    return running_sums(changes, "at", ["change", *parts]).withColumnRenamed("change", "active")


def week_over_week(usages: DataFrame, as_of: int) -> DataFrame:
    """Calls in the last 7 days, in the 7 before, and the change."""
    week = 7 * 86_400_000
    age = F.lit(as_of) - F.col("timestamp")
    out = usages.where((age >= 0) & (age < 2 * week)).agg(n_if(age < week).alias("this_week"), n_if(age >= week).alias("last_week"))
    return out.withColumn("change", F.col("this_week") - F.col("last_week"))


def dashboard(tools: DataFrame) -> DataFrame:
    """One row over tool_stats: totals, success rate, most used and most failed tool."""
    top = lambda c: F.min(F.struct((-F.col(c)).alias("k"), "tool_name")).getField("tool_name")
    out = tools.agg(F.sum("total_calls").alias("calls"), F.sum("success_count").alias("successes"), F.max("total_calls").alias("most_calls"), top("total_calls").alias("most_used"), top("failure_count").alias("most_failed"))
    return out.withColumn("success_rate", share_percent(F.col("successes"), F.col("calls")))


def calibrate(pairs: DataFrame) -> DataFrame:
    """Predictions with outcomes: relative errors, within-interval flags, scores (0 to 100) and their weighted overall."""
    error = lambda p, a: F.when(F.col(p) > 0, (F.col(a) - F.col(p)) / F.col(p)).otherwise(0.0)
    within = lambda e, c: F.abs(F.col(e)) <= F.when(F.col(c) == "high", rules.INTERVALS["high"]).when(F.col(c) == "medium", rules.INTERVALS["medium"]).otherwise(rules.INTERVALS["low"])
    score = lambda e: F.greatest(F.lit(0.0), F.lit(100.0) - F.abs(F.col(e)) * 100)
    out = pairs.withColumns({"duration_error": error("predicted_duration", "actual_duration"), "token_error": error("predicted_tokens", "actual_tokens")})
    out = out.withColumns({"duration_within": within("duration_error", "duration_confidence"), "token_within": within("token_error", "token_confidence"), "duration_score": score("duration_error"), "token_score": score("token_error"), "success_score": F.when(F.col("succeeded"), 100.0).otherwise(0.0)})
    return out.withColumn("overall", F.col("duration_score") * 0.4 + F.col("token_score") * 0.4 + F.col("success_score") * 0.2)


def calibration_trend(calibrated: DataFrame, as_of: int) -> DataFrame:
    """One row: mean of daily means of the last 7 days against the 7 before; improving, declining or stable within 5."""
    daily = calibrated.groupBy(F.floor(F.col("recorded_at") / 86_400_000).alias("d")).agg(F.avg("overall").alias("mean"))
    today = as_of // 86_400_000
    out = daily.agg(F.avg(F.when((F.col("d") > today - 7) & (F.col("d") <= today), F.col("mean"))).alias("recent"), F.avg(F.when((F.col("d") > today - 14) & (F.col("d") <= today - 7), F.col("mean"))).alias("previous"))
    gap = F.col("recent") - F.col("previous")
    return out.withColumn("trend", F.when(gap > 5, "improving").when(gap < -5, "declining").otherwise("stable"))


def cost_by_task(rows: DataFrame) -> DataFrame:
    """Per task type: sessions, cost and tokens, and their means."""
    return rows.groupBy("task_type").agg(F.count("*").alias("sessions"), F.sum("cost").alias("cost"), F.sum("tokens").alias("tokens"), F.avg("cost").alias("mean_cost"))


def tool_retries(usages: DataFrame) -> DataFrame:
    """Per tool: calls, failures, calls that repeat a failed one of the same signature, retry rate in percent."""
    w = Window.partitionBy("session_id", "signature").orderBy("pos")
    marked = usages.withColumn("retry", is_false(F.lag("success").over(w)))
    per = marked.groupBy("tool_name").agg(F.count("*").alias("calls"), n_if(is_false(F.col("success"))).alias("failures"), n_if(F.col("retry")).alias("retries"))
    return per.withColumn("retry_rate", share_percent(F.col("retries"), F.col("calls")))


def budget(costs: DataFrame, limit: float, warn_share: float = 0.8) -> DataFrame:
    """Cost per day against a limit: ok, warning from ``warn_share`` of it, exceeded beyond it."""
    per = costs.groupBy(day(F.col("timestamp")).alias("date")).agg(F.sum("cost").alias("cost"))
    return per.withColumn("alert", F.when(F.col("cost") > limit, "exceeded").when(F.col("cost") >= limit * warn_share, "warning").otherwise("ok"))


def top_n(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; order must end in a key so that ties have one answer."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def log_files(files: DataFrame) -> DataFrame:
    """Files, bytes and lines per kind, with the first and last date."""
    return files.groupBy("kind").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def estimated_size(rows: DataFrame) -> DataFrame:
    """Per session: lengths of input and response, plus 200 a call."""
    return rows.groupBy("session_id").agg(F.sum(F.length(F.coalesce("input", F.lit(""))) + F.length(F.coalesce("response", F.lit(""))) + 200).alias("size"))


def mean_score(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("sessions"), half_up(F.avg("score"), 1).alias("mean_score"))


def by_project_path(transcripts: DataFrame, projects: DataFrame, as_of: int | None = None, days: int = 30) -> DataFrame:
    """Transcripts (project_dir, modified_at, tests_ran, tests_failed) by the first project one of whose paths is a plain prefix.

    projects (project_pos, path_pos, project_id, project_name, project_path). Every project has a row, and rows without
    one are counted under a null id. A session succeeds if tests ran and none failed, and fails if some did.
    """
    rows = transcripts if as_of is None else transcripts.where(F.col("modified_at") >= as_of - days * 86_400_000)
    ran, failed = F.coalesce("tests_ran", F.lit(False)), F.coalesce("tests_failed", F.lit(0))
    per = first_prefix(rows, projects, "project_dir").groupBy("project_id").agg(F.count("*").alias("session_count"), F.count(F.when(ran & (failed == 0), 1)).alias("success_count"), F.count(F.when(ran & (failed > 0), 1)).alias("failure_count"))
    every = projects.groupBy("project_id").agg(F.min_by("project_name", F.struct("project_pos", "path_pos")).alias("project_name"))
    every = every.unionByName(every.sparkSession.createDataFrame([(None, None)], every.schema)).withColumnRenamed("project_id", "p")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return every.join(per, F.col("p").eqNullSafe(F.col("project_id")), "left").select(F.col("p").alias("project_id"), "project_name", zero("session_count"), zero("success_count"), zero("failure_count"))


def by_project(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """Per project, also those without rows, and for rows of none (project_id null): sessions, mean score, tests passed and failed."""
    per = rows.groupBy("project_id").agg(F.count("*").alias("sessions"), F.avg("score").alias("mean_score"), F.sum("tests_passed").alias("tests_passed"), F.sum("tests_failed").alias("tests_failed"))
    every = projects.select("project_id").distinct().unionByName(rows.where("project_id is null").select("project_id").distinct())
    out = every.withColumnRenamed("project_id", "p").join(per, F.col("p").eqNullSafe(F.col("project_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(F.col("p").alias("project_id"), zero("sessions"), "mean_score", zero("tests_passed"), zero("tests_failed"))


def combined(scored: DataFrame, days: int, as_of: int) -> dict[str, DataFrame]:
    """Overview, trend with its overall rate, histogram and percentiles of the same rows."""
    trend = daily_trend(scored, days, as_of)
    overall = trend.agg(F.sum("total").alias("total"), F.sum("success").alias("success")).withColumn("success_rate", share_percent(F.col("success"), F.col("total")))
    return {"overview": overview(scored), "trend": trend, "overall": overall, "histogram": quality_histogram(scored), "percentiles": index_percentiles(scored, "score")}


def contribution_stats(history: DataFrame) -> DataFrame:
    """Totals over successful contributions: uploads, sessions, bytes, first and last time."""
    ok = history.where("success")
    return ok.agg(F.count("*").alias("contributions"), F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
