"""Outcome signals, tags, quality dimensions and heuristic signals per session.

Usages here also have command, file_path, stdout, stderr, error; sessions have session_id, start_time, end_time,
last_activity, tool_count and commits (a number). Per-session aggregates are groupBys; last values are taken by pos.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.js import half_up, is_false, is_true, or_else
from ..functions.text import any_of
from .stats import n_if


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("int"), F.lit(0))


def test_result(output: Column, success: Column) -> Column:
    """passed, failed, skipped by the first of the output forms that fits; else 1 failed or 1 passed by words and success."""
    of = lambda p, a, b, c: F.struct(_number(output, p, a).alias("passed"), _number(output, p, b).alias("failed"), (_number(output, p, c) if c else F.lit(0)).alias("skipped"))
    const = lambda p, f: F.struct(F.lit(p).alias("passed"), F.lit(f).alias("failed"), F.lit(0).alias("skipped"))
    return (
        F.when(output.rlike(rules.TESTS_SUMMARY), of(rules.TESTS_SUMMARY, 1, 2, 3)).when(output.rlike(rules.TESTS_CARGO), of(rules.TESTS_CARGO, 2, 3, 0)).when(output.rlike(rules.TESTS_PLAIN), of(rules.TESTS_PLAIN, 1, 2, 3))
        .when(output.rlike(rules.TESTS_FAILURE_WORDS), const(0, 1)).when(is_true(success), const(1, 0)).otherwise(const(0, 0))
    )


def lint_result(output: Column) -> Column:
    """errors, warnings, fixed: the summary line if there is one, else the first counts."""
    summary = output.rlike(rules.LINT_ESLINT)
    pick = lambda g, p: F.when(summary, _number(output, rules.LINT_ESLINT, g)).otherwise(_number(output, p, 1))
    return F.struct(pick(2, rules.LINT_ERRORS).alias("errors"), pick(3, rules.LINT_WARNINGS).alias("warnings"), F.when(summary, 0).otherwise(_number(output, rules.LINT_FIXED, 1)).alias("fixed"))


def first_rule(text: Column, named: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(text.rlike("(?i)" + p), F.lit(name)) for p, name in named])


def outcome_signals(usages: DataFrame) -> DataFrame:
    """One row per session: last test, lint and build result, exit codes, git outcomes, time of the first green test."""
    bash = usages.where("tool_name = 'Bash'").withColumn("output", F.concat(F.coalesce("stdout", F.lit("")), F.lit("\n"), F.coalesce("stderr", F.lit(""))))
    command, ok = F.coalesce(F.col("command"), F.lit("")), F.col("success")
    test, lint, build = any_of(command, rules.TEST_COMMANDS), any_of(command, rules.LINT_COMMANDS), any_of(command, rules.BUILD_COMMANDS)
    rows = bash.withColumns({
        "test": F.when(test, test_result(F.col("output"), ok)), "lint": F.when(lint, lint_result(F.col("output"))),
        "linter": F.when(lint, F.struct(first_rule(command, [(x, x) for x in rules.LINTERS]).alias("name"))),
        "build": F.when(build, F.struct(is_true(ok).alias("ok"), or_else(F.col("duration_ms"), 0).alias("duration_ms"), first_rule(command, rules.BUILD_TOOLS).alias("tool"))),
        "green": F.when(test & is_true(ok) & ~F.coalesce(F.col("stdout"), F.lit("")).rlike(rules.TESTS_FAILURE_WORDS), F.col("timestamp")),
    })
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    git = lambda p, need: n_if(command.rlike("(?i)" + p) & (is_true(ok) if need else F.lit(True)))
    return rows.groupBy("session_id").agg(
        last("test").alias("test"), last("lint").alias("lint"), last("linter").getField("name").alias("linter"), last("build").alias("build"),
        n_if(is_true(ok)).alias("exit_successes"), n_if(is_false(ok)).alias("exit_failures"), F.min("green").alias("green_at"),
        git(rules.GIT_COMMIT, True).alias("commits_created"), git(rules.GIT_PUSH, True).alias("commits_pushed"), git(rules.GIT_REBASE, False).alias("rebases"), git(rules.GIT_STASH, False).alias("stashes"),
        F.coalesce(F.bool_or(F.col("output").rlike("(?i)" + rules.MERGE_CONFLICT)), F.lit(False)).alias("merge_conflicts"),
    )


def is_successful(outcomes: DataFrame) -> Column:
    """Tests, lint and build without failures where they ran, and over 0.7 of commands (plus one) successful."""
    bad = (F.coalesce(F.col("test.failed"), F.lit(0)) > 0) | (F.coalesce(F.col("lint.errors"), F.lit(0)) > 0) | is_false(F.col("build.ok"))
    return ~bad & (F.col("exit_successes") / (F.col("exit_successes") + F.col("exit_failures") + 1) > 0.7)


def infer_tags(items: DataFrame) -> DataFrame:
    """items (session_id, kind file or command, pos, text): one row per session, category and tag.

    The first item and rule that give a tag set its confidence and source; file tags come before command tags.
    """
    out = []
    for order, (kind, table) in enumerate((("file", rules.FILE_TAGS), ("command", rules.COMMAND_TAGS))):
        hits = F.array_compact(F.array(*[F.when(F.col("text").rlike("(?i)" + p), F.struct(F.lit(tag).alias("tag"), F.lit(cat).alias("category"), F.lit(conf).alias("confidence"), F.lit(i).alias("rule"))) for i, (p, tag, cat, conf) in enumerate(table)]))
        out.append(items.where(F.col("kind") == kind).select("session_id", F.lit(order).alias("kind_pos"), "pos", "kind", "text", F.explode(hits).alias("h")).select("session_id", "kind_pos", "pos", "kind", "text", "h.*"))
    first = out[0].unionByName(out[1]).groupBy("session_id", "category", "tag").agg(F.min(F.struct("kind_pos", "pos", "rule", "confidence", "kind", "text")).alias("f"))
    text = F.col("f.text")
    source = F.concat(F.col("f.kind"), F.lit(": "), F.substring(text, 1, 50), F.when(F.length(text) > 50, "...").otherwise(""))
    return first.select("session_id", "category", "tag", F.col("f.confidence").alias("confidence"), source.alias("inferred_from"), F.struct("f.kind_pos", "f.pos", "f.rule").alias("found_at"))


def task_types(sessions: DataFrame, tags: DataFrame, usages: DataFrame) -> DataFrame:
    """session_id, task_type: the task tag of highest confidence (the first found among equals), with defaults."""
    top = tags.where("category = 'task_type'").groupBy("session_id").agg(F.min(F.struct((-F.col("confidence")).alias("k"), "found_at", "tag")).getField("tag").alias("top"))
    use = usages.groupBy("session_id").agg(n_if(F.col("tool_name").isin(rules.READ_TOOLS)).alias("reads"), n_if(F.col("tool_name").isin(rules.WRITE_TOOLS)).alias("writes"))
    rows = sessions.join(top, "session_id", "left").join(use, "session_id", "left")
    reads, writes = F.coalesce(F.col("reads"), F.lit(0)), F.coalesce(F.col("writes"), F.lit(0))
    kind = (
        F.when(F.col("top").isin(rules.TASK_TYPES), F.col("top")).when(F.col("top").isNotNull(), "feature")
        .when((reads / (reads + writes + 1) > 0.8) & (F.col("commits") == 0), "exploration").when(F.col("commits") > 0, "feature").otherwise("unknown")
    )
    return rows.select("session_id", kind.alias("task_type"))


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x))


def _points(*cases: tuple[Column, int]) -> Column:
    """The points of the first case that holds; a null condition does not hold."""
    out = F
    for cond, n in cases:
        out = out.when(cond, n)
    return out.otherwise(0)


def quality_scores(sessions: DataFrame, usages: DataFrame, outcomes: DataFrame, loops: DataFrame, as_of: int) -> DataFrame:
    """Dimensions, overall score, class and heuristic score per session. loops: loop_rollup rows."""
    use = usages.groupBy("session_id").agg(
        F.count("*").alias("calls"), n_if(is_false(F.col("success"))).alias("failures"), n_if((F.col("tool_name") == "Bash") & F.col("command").rlike(rules.DANGEROUS_COMMANDS)).alias("dangers"),
        n_if(is_false(F.col("success")) & F.col("error").rlike(rules.PERMISSION_WORDS)).alias("denied"),
    )
    rows = sessions.join(use, "session_id", "left").join(outcomes, "session_id", "left").join(loops.select("session_id", "loops", "total_retries"), "session_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    passed, failed = F.col("test.passed"), F.col("test.failed")
    gap = F.col("end_time") - F.col("last_activity")
    completion = F.lit(50) + _points((zero("commits") > 0, 20)) + _points((passed > 0, 15)) + _points(((passed > 0) & (failed == 0), 10)) + _points((F.col("build.ok"), 10), (is_false(F.col("build.ok")), -15)) + _points((failed > 0, -20)) + _points((gap < 60_000, 5))
    errors, warnings = F.col("lint.errors"), F.col("lint.warnings")
    code = F.lit(60) + _points(((errors == 0) & (warnings == 0), 20), (errors == 0, 10), (errors > 0, -20)) + _points((F.col("lint.fixed") > 0, 5)) + _points((passed > 0, 15))
    rate = zero("failures") / F.greatest(zero("calls"), F.lit(1))
    tools = F.when(zero("tool_count") != 0, F.col("tool_count")).otherwise(zero("calls"))
    minutes = F.greatest(F.lit(1.0), (F.coalesce("end_time", F.lit(as_of)) - F.col("start_time")) / 60_000)
    pace = tools / minutes
    looped = zero("loops") > 0
    efficiency = F.lit(70) - F.when(looped, zero("loops") * 10 + F.least(F.lit(20), zero("total_retries") * 2)).otherwise(0) + _points((rate > 0.3, -20), (rate > 0.2, -10)) + _points((tools.between(3, 100), 10), (tools > 500, -15)) + _points((pace.between(0.5, 15), 5), (pace > 30, -10))
    safety = F.lit(80) - zero("dangers") * 15 + _points((F.col("merge_conflicts"), -10)) + F.when(zero("denied") == 0, 10).otherwise(zero("denied") * -5)
    rows = rows.withColumns({"completion": _clamp(completion), "code_quality": _clamp(code), "efficiency": _clamp(efficiency), "safety": _clamp(safety)})
    weighted = reduce(lambda a, b: a + b, [F.col(d) * w for d, w in rules.DIMENSION_WEIGHTS.items()])
    overall = half_up(weighted / sum(rules.DIMENSION_WEIGHTS.values()))
    overall = F.when(looped, F.greatest(F.lit(0), overall - 10)).otherwise(overall)
    signals = {"no_failures": rate < 0.2, "has_commits": zero("commits") > 0, "normal_end": F.coalesce(gap < 60_000, F.lit(True)), "reasonable_tool_count": tools.between(3, 500), "healthy_pacing": pace.between(0.5, 20)}
    heuristic = reduce(lambda a, b: a + b, [F.when(c, rules.SIGNAL_WEIGHTS[s]).otherwise(0) for s, c in signals.items()])
    rows = rows.withColumns({"overall": overall, "heuristic_score": heuristic})
    return rows.select("session_id", "completion", "code_quality", "efficiency", "safety", "overall", classify(F.col("overall")).alias("classification"), "heuristic_score", classify_heuristic(F.col("heuristic_score")).alias("heuristic"))


def classify(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").when(score > 0, "poor").otherwise("unknown")


# What is said of each dimension from 70 up and below 40.
DIMENSION_WORDS = {
    "completion": ("task completed", "task may be incomplete"),
    "code_quality": ("good code quality", "code quality issues"),
    "efficiency": ("efficient workflow", "inefficient workflow"),
    "safety": ("safe operations", "safety concerns"),
}
# The color of each class; others are gray.
CLASS_COLORS = {"excellent": "green", "good": "blue", "fair": "yellow", "poor": "red"}


def class_color(classification: Column) -> Column:
    return F.coalesce(*[F.when(classification == k, F.lit(v)) for k, v in CLASS_COLORS.items()], F.lit("gray"))


def describe(overall: Column, classification: Column, **dimensions: Column) -> Column:
    """A sentence on a score: its class, and what is strong and weak in it."""
    said = lambda test, which: F.array_join(F.array_compact(F.array(*[F.when(test(c), F.lit(DIMENSION_WORDS[d][which])) for d, c in dimensions.items()])), ", ")
    strong, weak = said(lambda c: c >= 70, 0), said(lambda c: c < 40, 1)
    head = F.concat(F.initcap(classification), F.lit(" ("), overall.cast("string"), F.lit("/100)"))
    return F.concat_ws(". ", head, F.when(strong != "", F.concat(F.lit("Strengths: "), strong)), F.when(weak != "", F.concat(F.lit("Areas to improve: "), weak)))


def classify_heuristic(score: Column) -> Column:
    return F.when(score >= 70, "likely_success").when(score < 40, "likely_failure").otherwise("uncertain")


def latest_versions(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last version of each entity of an append-only log."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return log.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
