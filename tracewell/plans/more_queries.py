"""More registered queries: scalars, parsers, listings and joins of processes and projects on the driver's tables."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import text
from ..operators import diffs, filters, joins, monitor, quality, redact, stats, transcripts
from . import adapters as on
from .queries import NORM, S, U, query


def _pick(number, *values):
    """The value at number modulo their count."""
    return F.element_at(F.array(*[v if hasattr(v, "alias") else F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


SIGNED = NORM.replace("COL", "url")


@query(rf"""WITH p AS (SELECT page_id, url, html, list_value('Bash', 'Edit', 'Write', 'Read', 'WebFetch')[page_id % 5 + 1] AS tool, CASE WHEN string_split(url, '/')[-1] = '' THEN url ELSE string_split(url, '/')[-1] END AS name FROM pages)
 SELECT page_id, CASE tool WHEN 'Bash' THEN 'Bash:' || {SIGNED} WHEN 'Edit' THEN 'Edit:' || name || ':' || length(html) WHEN 'WebFetch' THEN tool ELSE tool || ':' || name END AS signature FROM p""")
def op_signature(spark, d):
    url = F.col("url")
    tool = _pick(F.col("page_id"), "Bash", "Edit", "Write", "Read", "WebFetch")
    return on.table(spark, d, "pages").select("page_id", text.operation_signature(tool, url, url, F.col("html")).alias("signature"))


@query(rf"""SELECT page_id, CASE WHEN page_id % 2 = 1 THEN CASE WHEN page_id % 3 = 0 THEN {NORM.replace('COL', 'url[1:100]')} WHEN page_id % 5 = 0 THEN {NORM.replace('COL', 'html[1:100]')} ELSE 'unknown error' END END AS message FROM pages""")
def error_text(spark, d):
    i = F.col("page_id")
    return on.table(spark, d, "pages").select("page_id", text.error_message(i % 2 == 0, F.when(i % 3 == 0, F.col("url")), F.when(i % 5 == 0, F.col("html")).otherwise("")).alias("message"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 4 THEN 0 WHEN 5 THEN CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END ELSE n_chars % 50 END AS passed, CASE doc_id % 6 WHEN 0 THEN n_chars % 7 WHEN 1 THEN n_chars % 7 WHEN 2 THEN n_chars % 7 WHEN 4 THEN 1 ELSE 0 END AS failed, CASE doc_id % 6 WHEN 0 THEN n_chars % 3 WHEN 2 THEN n_chars % 3 ELSE 0 END AS skipped FROM documents""")
def test_results(spark, d):
    a, b, c = ((F.col("n_chars") % k).cast("string") for k in (50, 7, 3))
    output = _pick(F.col("doc_id"), F.concat(F.lit("Tests: "), a, F.lit(" passed, "), b, F.lit(" failed, "), c, F.lit(" skipped")), F.concat(F.lit("test result: FAILED. "), a, F.lit(" passed; "), b, F.lit(" failed")), F.concat(a, F.lit(" passed "), b, F.lit(" failed, "), c, F.lit(" skipped")), F.concat(a, F.lit(" passed")), "FAIL src/x", "nothing to say")
    return on.table(spark, d, "documents").withColumn("r", quality.test_result(output, F.col("doc_id") % 4 == 1)).select("doc_id", "r.passed", "r.failed", "r.skipped")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN 0 ELSE n_chars % 9 END AS errors, CASE doc_id % 3 WHEN 2 THEN 0 ELSE n_chars % 5 END AS warnings, CASE doc_id % 3 WHEN 1 THEN n_chars % 4 ELSE 0 END AS fixed FROM documents""")
def lint_results(spark, d):
    e, w, f = ((F.col("n_chars") % k).cast("string") for k in (9, 5, 4))
    output = _pick(F.col("doc_id"), F.concat(F.lit("14 problems ("), e, F.lit(" errors, "), w, F.lit(" warnings) 3 fixed")), F.concat(e, F.lit(" errors and "), w, F.lit(" warnings; "), f, F.lit(" files auto-fixed")), "all clean")
    return on.table(spark, d, "documents").withColumn("r", quality.lint_result(output)).select("doc_id", "r.errors", "r.warnings", "r.fixed")


@query("""SELECT doc_id, list_value('eslint', 'prettier', NULL, 'ruff', NULL, NULL)[doc_id % 6 + 1] AS linter, list_value(NULL, 'npm-script', 'tsc', NULL, 'go', 'make')[doc_id % 6 + 1] AS build_tool FROM documents""")
def tool_names(spark, d):
    from ..functions import rules

    command = _pick(F.col("doc_id"), "npx eslint . && ruff", "yarn run build --prettier", "npx tsc -p .", "ruff check", "go build ./...", "make all")
    return on.table(spark, d, "documents").select("doc_id", quality.first_rule(command, [(x, x) for x in rules.LINTERS]).alias("linter"), quality.first_rule(command, rules.BUILD_TOOLS).alias("build_tool"))


COMMANDS = {"click": "npm test", "view": "eslint src", "purchase": "cargo build", "signup": "git commit -m fix", "error": "git push && pytest"}


def _runs(spark, d):
    """Events as commands: the type gives the command, the value its output."""
    n = F.floor("value").cast("long")
    u = on.usages(spark, d).withColumn("value", F.col("duration_ms"))
    out = F.when(F.col("tool_name") == "click", F.concat(F.lit("Tests: "), n.cast("string"), F.lit(" passed, "), (n % 3).cast("string"), F.lit(" failed"))).when(F.col("tool_name") == "view", F.concat(F.lit("5 problems ("), (n % 4).cast("string"), F.lit(" errors, "), (n % 5).cast("string"), F.lit(" warnings)"))).otherwise("")
    u = u.withColumns({"command": F.element_at(F.create_map(*[F.lit(x) for kv in COMMANDS.items() for x in kv]), F.col("tool_name")), "stdout": out, "stderr": F.lit(None).cast("string"), "success": F.pmod(n, F.lit(4)) != 0})
    return u.withColumn("tool_name", F.lit("Bash"))


OUTCOMES = U + """, r AS (SELECT session_id, event_id, timestamp, tool_name AS k, CAST(floor(duration_ms) AS BIGINT) AS n, duration_ms, CAST(floor(duration_ms) AS BIGINT) % 4 <> 0 AS ok FROM u),
 o AS (SELECT session_id, arg_max(CASE WHEN k = 'click' THEN n WHEN ok THEN 1 ELSE 0 END, (timestamp, event_id)) FILTER (k IN ('click', 'error')) AS passed, arg_max(CASE WHEN k = 'click' THEN n % 3 ELSE 0 END, (timestamp, event_id)) FILTER (k IN ('click', 'error')) AS failed,
 arg_max(n % 4, (timestamp, event_id)) FILTER (k = 'view') AS lint_errors, arg_max(n % 5, (timestamp, event_id)) FILTER (k = 'view') AS lint_warnings, max(CASE WHEN k = 'view' THEN 'eslint' END) AS linter, arg_max(ok, (timestamp, event_id)) FILTER (k = 'purchase') AS build_ok, max(CASE WHEN k = 'purchase' THEN 'cargo' END) AS build_tool,
 count(*) FILTER (ok) AS exit_successes, count(*) FILTER (NOT ok) AS exit_failures, min(timestamp) FILTER (ok AND k = 'error') AS green_at, count(*) FILTER (ok AND k = 'signup') AS commits_created, count(*) FILTER (ok AND k = 'error') AS commits_pushed FROM r GROUP BY 1) """


def _outcomes(spark, d):
    return quality.outcome_signals(_runs(spark, d))


@query(OUTCOMES + "SELECT session_id, CAST(passed AS INTEGER) AS passed, CAST(failed AS INTEGER) AS failed, CAST(lint_errors AS INTEGER) AS lint_errors, CAST(lint_warnings AS INTEGER) AS lint_warnings, linter, build_ok, build_tool, exit_successes, exit_failures, green_at, commits_created, commits_pushed FROM o")
def outcomes(spark, d):
    """Last test, lint and build results, exit codes, git outcomes and the first green test of each session."""
    o = _outcomes(spark, d)
    return o.select("session_id", F.col("test.passed").alias("passed"), F.col("test.failed").alias("failed"), F.col("lint.errors").alias("lint_errors"), F.col("lint.warnings").alias("lint_warnings"), "linter", F.col("build.ok").alias("build_ok"), F.col("build.tool").alias("build_tool"), "exit_successes", "exit_failures", "green_at", "commits_created", "commits_pushed")


@query(OUTCOMES + "SELECT session_id, NOT (coalesce(failed, 0) > 0 OR coalesce(lint_errors, 0) > 0 OR coalesce(NOT build_ok, false)) AND exit_successes / (exit_successes + exit_failures + 1) > 0.7 AS successful FROM o")
def successful_sessions(spark, d):
    o = _outcomes(spark, d)
    return o.select("session_id", quality.is_successful(o).alias("successful"))


@query("""WITH h AS (SELECT * FROM (VALUES ('click', 0, 'task_type', 'test', 0.9, 'file: src/components/a.test.ts'), ('click', 0, 'language', 'typescript', 0.9, 'file: src/components/a.test.ts'), ('click', 0, 'domain', 'frontend', 0.7, 'file: src/components/a.test.ts'),
 ('view', 0, 'task_type', 'docs', 0.7, 'file: docs/readme.md'), ('purchase', 1, 'task_type', 'build', 0.7, 'command: cargo build'), ('signup', 1, 'task_type', 'bugfix', 0.7, 'command: git commit -m ''fix bug'''), ('error', 1, 'task_type', 'test', 0.9, 'command: pytest')) v(event_type, kind_pos, category, tag, confidence, source)),
 x AS (SELECT CAST(user_id AS VARCHAR) AS session_id, h.*, row_number() OVER (PARTITION BY user_id, category, tag ORDER BY kind_pos, ts, event_id) AS rn FROM events JOIN h USING (event_type))
 SELECT session_id, category, tag, CAST(confidence AS DOUBLE) AS confidence, source AS inferred_from FROM x WHERE rn = 1""")
def session_tags(spark, d):
    """Tags of sessions with files and commands made from the events."""
    u = on.usages(spark, d)
    texts = {"click": ("file", "src/components/a.test.ts"), "view": ("file", "docs/readme.md"), "purchase": ("command", "cargo build"), "signup": ("command", "git commit -m 'fix bug'"), "error": ("command", "pytest")}
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in texts.items() for x in (k, v[i])]), F.col("tool_name"))
    tags = quality.infer_tags(u.select("session_id", pick(0).alias("kind"), "pos", pick(1).alias("text")))
    return tags.select("session_id", "category", "tag", "confidence", "inferred_from")


@query("""WITH t AS (SELECT doc_id AS session_id, list_value('bugfix', 'lint', NULL, 'docs')[doc_id % 4 + 1] AS top, n_chars % 3 AS commits, n_chars % 11 AS reads, n_chars % 2 AS writes FROM documents)
 SELECT session_id, CASE WHEN top = 'lint' THEN 'feature' WHEN top IS NOT NULL THEN top WHEN reads / (reads + writes + 1) > 0.8 AND commits = 0 THEN 'exploration' WHEN commits > 0 THEN 'feature' ELSE 'unknown' END AS task_type FROM t""")
def task_types(spark, d):
    docs = on.table(spark, d, "documents").withColumnRenamed("doc_id", "session_id")
    sessions = docs.select("session_id", (F.col("n_chars") % 3).alias("commits"))
    tag = _pick(F.col("session_id"), "bugfix", "lint", F.lit(None).cast("string"), "docs")
    tags = docs.select("session_id", F.lit("task_type").alias("category"), tag.alias("tag"), F.lit(0.8).alias("confidence"), F.lit(1).alias("found_at")).where("tag is not null")
    tags = tags.unionByName(tags.withColumns({"tag": F.lit("config"), "confidence": F.lit(0.5), "found_at": F.lit(0)}))
    calls = F.concat(F.array_repeat(F.lit("Read"), (F.col("n_chars") % 11).cast("int")), F.array_repeat(F.lit("Edit"), (F.col("n_chars") % 2).cast("int")))
    return quality.task_types(sessions, tags, docs.select("session_id", F.explode(calls).alias("tool_name")))


@query(r"""WITH w AS (SELECT page_id, regexp_replace(url, '[^A-Za-z0-9+/=_-]', '', 'g') AS word FROM pages), c AS (SELECT page_id, unnest(string_split(word, '')) AS ch FROM w), n AS (SELECT page_id, ch, count(*) AS k, sum(count(*)) OVER (PARTITION BY page_id) AS n FROM c WHERE ch <> '' GROUP BY 1, 2), e AS (SELECT page_id, sum(-k / n * log2(k / n)) AS bits FROM n GROUP BY 1)
 SELECT page_id, length(word) >= 20 AND NOT regexp_full_match(word, '[0-9a-fA-F]+|[A-Za-z]+') AND bits >= 4.0 AS high FROM w JOIN e USING (page_id)""")
def high_entropy(spark, d):
    return on.table(spark, d, "pages").select("page_id", text.is_high_entropy(F.regexp_replace("url", "[^A-Za-z0-9+/=_-]", "")).alias("high"))


@query("SELECT source AS kind, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, strftime(DATE '2024-01-01' + CAST(min(doc_id) AS INTEGER), '%Y-%m-%d') AS first_date, strftime(DATE '2024-01-01' + CAST(max(doc_id) AS INTEGER), '%Y-%m-%d') AS last_date FROM documents GROUP BY 1")
def process_log_summary(spark, d):
    files = on.table(spark, d, "documents").select(F.col("source").alias("kind"), F.col("n_chars").alias("bytes"), F.size(F.split("text", "\n")).alias("lines"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("doc_id").cast("int")), "yyyy-MM-dd").alias("date"))
    return stats.log_files(files)


@query("SELECT count(*) AS contributions, CAST(sum(o_custkey) AS BIGINT) AS sessions, CAST(sum(o_orderkey) AS BIGINT) AS bytes, min(o_orderkey * 1000) AS first_at, max(o_orderkey * 1000) AS last_at FROM orders WHERE o_orderstatus <> 'F'")
def contribution_stats(spark, d):
    return stats.contribution_stats(on.table(spark, d, "orders").select((F.col("o_orderstatus") != "F").alias("success"), F.col("o_custkey").alias("sessions"), F.col("o_orderkey").alias("bytes"), (F.col("o_orderkey") * 1000).alias("at")))


@query("SELECT doc_id AS session_id, CAST(length(text) + length(source) + 200 AS BIGINT) AS size FROM documents")
def estimated_size(spark, d):
    return stats.estimated_size(on.table(spark, d, "documents").select(F.col("doc_id").alias("session_id"), F.col("text").alias("input"), F.col("source").alias("response")))


@query("SELECT o_orderpriority AS task_type, count(*) AS sessions, round(sum(o_totalprice), 2) AS cost, CAST(sum(o_custkey) AS BIGINT) AS tokens, round(avg(o_totalprice), 6) AS mean_cost FROM orders GROUP BY 1")
def cost_by_task(spark, d):
    rows = on.table(spark, d, "orders").select(F.col("o_orderpriority").alias("task_type"), F.col("o_totalprice").alias("cost"), F.col("o_custkey").alias("tokens"))
    return stats.cost_by_task(rows).withColumns({"cost": F.round("cost", 2), "mean_cost": F.round("mean_cost", 6)})


@query(S + f"SELECT count(*) AS total, count(*) FILTER (score >= 60) AS success, floor(count(*) FILTER (score >= 60) * 1000.0 / count(*) + 0.5) / 10.0 AS success_rate FROM s WHERE modified_at >= {on.AS_OF - 30 * 86_400_000}")
def combined_overall(spark, d):
    return stats.combined(on.scored(spark, d), 30, on.AS_OF)["overall"]


def _processes(spark, d):
    """Customers as processes: a parent of each, and as label the market segment."""
    c = on.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("pid"), F.floor(F.col("c_custkey") / 3).alias("ppid"), F.col("c_mktsegment").alias("label"), F.col("c_nationkey").cast("string").alias("cwd"), F.col("c_custkey").alias("pos"))


@query("""SELECT o_orderkey AS port, coalesce(a.c_mktsegment, b.c_mktsegment) AS agent_label FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) a ON a.c_custkey = o_custkey LEFT JOIN customer p ON p.c_custkey = o_custkey LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) b ON b.c_custkey = p.c_custkey // 3""")
def port_agents(spark, d):
    p = _processes(spark, d)
    ports = on.table(spark, d, "orders").select(F.col("o_orderkey").alias("port"), F.col("o_custkey").alias("pid"))
    return monitor.port_agents(ports, p.where("pid % 2 = 0"), p).select("port", "agent_label")


@query("SELECT c_custkey AS pid FROM customer c WHERE NOT EXISTS (SELECT 1 FROM customer p WHERE p.c_custkey = c.c_custkey // 3 AND p.c_mktsegment = c.c_mktsegment)")
def without_children(spark, d):
    return monitor.without_children(_processes(spark, d)).select("pid")


@query("SELECT s_suppkey AS session_id, m.pid AS live_pid FROM supplier LEFT JOIN (SELECT c_nationkey, max(c_custkey) AS pid FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) m ON m.c_nationkey = s_nationkey")
def live_pids(spark, d):
    sessions = on.table(spark, d, "supplier").select(F.col("s_suppkey").alias("session_id"), F.col("s_nationkey").cast("string").alias("cwd"))
    return joins.live_pids(sessions, _processes(spark, d), "BUILDING").select("session_id", "live_pid")


@query("SELECT doc_id AS prediction_id, quality AS recorded_at FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def open_predictions(spark, d):
    p = on.table(spark, d, "documents").select(F.col("doc_id").alias("prediction_id"))
    o = on.table(spark, d, "labels").select(F.col("doc_id").alias("prediction_id"), F.col("quality").alias("recorded_at"))
    return filters.predictions_with_outcomes(p, o, False)


@query("""WITH r AS (SELECT '/r/' || p_partkey AS path, CASE WHEN p_partkey % 7 <> 0 THEN '(' || p_brand || ' ' || p_type || ')' END AS name, p_partkey % 5 = 0 AS is_known FROM part),
 s AS (SELECT *, regexp_replace(regexp_replace(lower(coalesce(name, regexp_extract(path, '[^/]*$'))), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM r), u AS (SELECT DISTINCT slug FROM s WHERE is_known),
 n AS (SELECT path, s.slug, row_number() OVER (PARTITION BY s.slug ORDER BY path) - 1 + CASE WHEN u.slug IS NULL THEN 0 ELSE 1 END AS n FROM s LEFT JOIN u ON u.slug = s.slug WHERE NOT is_known)
 SELECT path, slug || coalesce((SELECT string_agg('-' || k, '' ORDER BY k) FROM unnest(range(1, n + 1)) v(k)), '') AS project_id FROM n""")
def infer_projects(spark, d):
    """Parts as repositories, a seventh without a name; each fifth is known, under the id of its name."""
    k = F.col("p_partkey")
    repos = on.table(spark, d, "part").select(F.concat(F.lit("/r/"), k.cast("string")).alias("path"), F.when(k % 7 != 0, F.concat(F.lit("("), "p_brand", F.lit(" "), "p_type", F.lit(")"))).alias("name"), (k % 5 == 0).alias("is_known"))
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("name", F.regexp_extract("path", "[^/]*$", 0))), "[^a-z0-9]+", "-"), "^-|-$", "")
    return joins.infer_projects(repos.drop("is_known"), repos.where("is_known").select("path", slug.alias("project_id"))).select("path", "project_id")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 9 <> 0 THEN n_chars END AS size_bytes FROM documents ORDER BY size_bytes ASC NULLS LAST, id LIMIT 100")
def smallest_contributions(spark, d):
    rows = on.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 9 != 0, F.col("n_chars")).alias("size_bytes"), F.col("n_chars").alias("modified_at"))
    return rows.orderBy(*filters.contribution_order("smallest")).limit(100).select("id", "size_bytes")


@query(r"""WITH c AS (SELECT page_id, CASE WHEN contains(url, '#') THEN 'bash -c ' || url ELSE 'node ' || url END AS cmd, regexp_extract(url, '^https?://([^/]*)', 1) AS exe FROM pages)
 SELECT page_id, CASE WHEN starts_with(cmd, 'bash -c ') THEN NULL WHEN regexp_matches(cmd, '(?i)\bEN\b') THEN 'agent' WHEN starts_with(exe, 'th') THEN 'editor' WHEN ends_with(exe, '.org') THEN 'server' END AS label FROM c""")
def match_process(spark, d):
    """Addresses of pages as command lines, hosts as programs; those with a fragment run in a shell."""
    url = F.col("url")
    cmd = F.when(url.contains("#"), F.concat(F.lit("bash -c "), url)).otherwise(F.concat(F.lit("node "), url))
    matchers = [{"label": "agent", "kind": "cmd_regex", "pattern": r"\bEN\b"}, {"label": "editor", "kind": "exe_prefix", "pattern": "th"}, {"label": "server", "kind": "exe_suffix", "pattern": ".org"}]
    return on.table(spark, d, "pages").select("page_id", filters.match_process(cmd, F.regexp_extract(url, "^https?://([^/]*)", 1), matchers).alias("label"))


@query(r"""WITH c AS (SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'docker run ' ELSE 'sh ' END || replace(replace(substr(text, 1, 200), ' the ', ' claude '), ' la ', ' --sandbox ') AS cmd FROM documents)
 SELECT doc_id, CASE WHEN regexp_matches(cmd, '(?i)docker\s+(run|exec)') AND regexp_matches(cmd, '(?i)claude-sandbox|claude-code-config|\bclaude\b') THEN 'docker' WHEN contains(cmd, '--sandbox ') THEN 'macos' END AS sandbox FROM c""")
def sandboxes(spark, d):
    """Beginnings of documents as command lines, two of their words written as marks of sandboxes."""
    words = F.replace(F.replace(F.substring("text", 1, 200), F.lit(" the "), F.lit(" claude ")), F.lit(" la "), F.lit(" --sandbox "))
    command = F.concat(F.when(F.col("n_chars") % 2 == 0, "docker run ").otherwise("sh "), words)
    return on.table(spark, d, "documents").select("doc_id", text.sandbox(command).alias("sandbox"))


_HUB = [("^https?://[^/]*[.]example[.]com/en/", "https://github.com/a/b/pull/"), ("^https?://[^/]*[.]example[.]com/fr/", "https://github.com/a/b/issues/"), ("^https?://[^/]*[.]example[.]com/de/", "https://github.com/a/b/commit/"), ("^https?://[^/]*[.]example[.]com/", "https://github.com/a/b/"), ("^https?://[^/]*[.]example[.]net/en", "file:///en"), ("^http://[^/]*[.]example[.]net", "/w"), ("^http:", "ftp:")]


@query("WITH u AS (SELECT page_id, " + functools.reduce(lambda x, r: f"regexp_replace({x}, '{r[0]}', '{r[1]}')", _HUB, "url") + """ AS u FROM pages)
 SELECT page_id, CASE WHEN contains(u, '/pull/') THEN 'github_pr' WHEN contains(u, '/commit/') THEN 'github_commit' WHEN contains(u, '/issues/') THEN 'github_issue' WHEN starts_with(u, 'https://github.com/') THEN 'github_repo' WHEN starts_with(u, 'file://') OR starts_with(u, '/') THEN 'file' WHEN regexp_matches(u, '^https?://') THEN 'url' ELSE 'other' END AS kind FROM u""")
def artifact_types(spark, d):
    """Addresses of pages, of which some hosts and languages are written as those of code hosts and files."""
    return on.table(spark, d, "pages").select("page_id", text.artifact_type(functools.reduce(lambda x, r: F.regexp_replace(x, *r), _HUB, F.col("url"))).alias("kind"))


@query("SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'claude' WHEN contains(url, '/fr/') THEN 'codex' WHEN contains(url, '/de/') THEN 'gemini' END AS agent FROM pages")
def agents_of_paths(spark, d):
    """Addresses of pages as paths, their languages written as the agents' folders."""
    path = functools.reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), [("/en/", "/.claude/"), ("/fr/", "/.codex/"), ("/de/", "/.gemini/")], F.col("url"))
    return on.table(spark, d, "pages").select("page_id", text.detect_agent(path).alias("agent"))


@query("SELECT o_orderkey, CAST(o_custkey % 60 + (o_custkey // 60) % 60 * 60 + (o_orderkey % 24) * 3600 + CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 9) * 86400 ELSE 0 END AS BIGINT) AS seconds FROM orders")
def etimes(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    etime = F.concat(F.when(k % 2 == 0, F.concat((c % 9).cast("string"), F.lit("-"))).otherwise(""), F.format_string("%02d:%02d:%02d", k % 24, F.floor(c / 60) % 60, c % 60))
    return on.table(spark, d, "orders").select("o_orderkey", text.etime_seconds(etime).alias("seconds"))


@query(r"""WITH w AS (SELECT doc_id, coalesce(nullif(regexp_extract(text, '[A-Za-z]+'), ''), 'u') AS w FROM documents)
 SELECT doc_id, '/home/<USER>/' || w AS path, 'run --token [REDACTED] -password=[REDACTED] in C:\Users\<USER>\' || w AS command FROM w""")
def sanitized(spark, d):
    """The first word of each document as user, secret and file."""
    w = F.coalesce(F.nullif(F.regexp_extract("text", "[A-Za-z]+", 0), F.lit("")), F.lit("u"))
    command = F.concat(F.lit("run --token "), w, F.lit(" -password="), w, F.lit(" in C:\\Users\\"), w, F.lit("\\"), w)
    return on.table(spark, d, "documents").select("doc_id", text.hide_user(F.concat(F.lit("/home/"), w, F.lit("/"), w)).alias("path"), text.hide_user(text.hide_flags(command)).alias("command"))


@query(r"SELECT doc_id, substr(md5(text), 1, 12) AS hash, rtrim(substr(trim(regexp_replace(substr(text, 1, 400), '[ \n]+', ' ', 'g')), 1, 200)) AS message FROM documents WHERE regexp_matches(substr(text, 1, 400), '[A-Za-z]')")
def commits(spark, d):
    """Output of git with the beginning of each document that has a letter there as message."""
    message = F.trim(F.regexp_replace(F.substring("text", 1, 400), "[ \\n]+", " "))
    out = F.concat(F.lit("[main "), F.substring(F.md5("text"), 1, 12), F.lit("] "), message, F.lit("\n 1 file changed"))
    rows = on.table(spark, d, "documents").where(F.substring("text", 1, 400).rlike("[A-Za-z]"))
    return rows.select("doc_id", text.commit_hash(out).alias("hash"), F.rtrim(text.commit_message(out)).alias("message"))


def _fixed(x: str, digits: int) -> str:
    """SQL of a number with so many decimals, by the exact fraction, ties up."""
    part = f"CAST(floor(({x} - floor({x})) * {10**digits} + 0.5) AS BIGINT)"
    return f"(CAST(floor({x}) AS BIGINT) + CASE WHEN {part} >= {10**digits} THEN 1 ELSE 0 END) || '.' || lpad(CAST({part} % {10**digits} AS VARCHAR), {digits}, '0')"


@query(f"SELECT o_orderkey, CASE WHEN n >= 1000000 THEN {_fixed('(n / 1000000)', 1)} || 'M' WHEN n >= 1000 THEN {_fixed('(n / 1000)', 1)} || 'K' ELSE CAST(n AS VARCHAR) END AS tokens, '$' || CASE WHEN c < 0.01 THEN {_fixed('c', 4)} ELSE {_fixed('c', 2)} END AS cost FROM (SELECT o_orderkey, o_orderkey * o_custkey AS n, (o_orderkey % 64) / 512 AS c FROM orders)")
def formatted(spark, d):
    k = F.col("o_orderkey")
    return on.table(spark, d, "orders").select("o_orderkey", text.format_tokens(k * F.col("o_custkey")).alias("tokens"), text.format_cost((k % 64) / 512.0).alias("cost"))


MESSAGES = """WITH m AS (SELECT conv_id AS session_id, turn AS pos, conv_id || ':' || turn AS tool_use_id, CASE WHEN role = 'assistant' THEN 'Bash' END AS tool_name, 1704067200000 + turn * 1000 + conv_id * 60000 AS t, turn % 4 AS k FROM conversations) """


def _messages(spark, d):
    at = F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("turn") * 1000 + F.col("conv_id") * 60_000)
    result = _pick(F.col("turn"), '{"error":"x"}', '{"success":true}', "it failed", "fine")
    return on.table(spark, d, "conversations").select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("line"), F.concat_ws(":", "conv_id", "turn").alias("message_id"), F.when(F.col("role") == "assistant", "Bash").alias("tool_name"), F.col("text").alias("tool_input"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), result.alias("tool_result"))


@query(MESSAGES + "SELECT session_id, pos, tool_use_id, tool_name, t AS timestamp, k IN (1, 3) AS success FROM m WHERE tool_name IS NOT NULL")
def transcript_usages(spark, d):
    return transcripts.to_usages(_messages(spark, d)).drop("tool_input")


@query(MESSAGES + "SELECT session_id, min(t) AS start_time, max(t) AS end_time, arg_max(t, pos) AS last_activity, count(tool_name) AS tool_count FROM m GROUP BY 1")
def transcript_sessions(spark, d):
    return transcripts.to_sessions(_messages(spark, d))


@query(r"""SELECT pattern, count(*) AS matches, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, 'digits' AS pattern, unnest(regexp_extract_all(text, '[0-9]{4,}')) AS m FROM documents UNION ALL SELECT doc_id, 'mail', unnest(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9]+')) FROM documents) GROUP BY 1""")
def pattern_summary(spark, d):
    hits = transcripts.pattern_matches(on.table(spark, d, "documents"), {"digits": "[0-9]{4,}", "mail": "[a-z0-9.]+@[a-z0-9]+"}, "doc_id")
    return hits.groupBy("pattern").agg(F.count("*").alias("matches"), F.countDistinct("doc_id").alias("documents"))


@query("SELECT conv_id, coalesce(string_agg(CASE WHEN role = 'user' THEN '+' ELSE ' ' END || 'l' || turn, chr(10) ORDER BY turn), '') AS diff FROM conversations GROUP BY 1")
def line_diffs(spark, d):
    """Lines that only the later text has are added, the others kept."""
    c = on.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    lines = lambda rows: F.array_join(F.transform(rows, lambda x: F.concat(F.lit("l"), x.turn.cast("string"))), "\n")
    old, new = lines(F.filter("t", lambda x: x.role != "user")), lines(F.col("t"))
    added = F.regexp_replace(diffs.line_diff(old, new), r"(?m)^-\n?", "")
    return c.select("conv_id", added.alias("diff"))


@query(r"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '@'))) AS lines FROM documents WHERE contains(text, '@')""")
def text_changes(spark, d):
    """Documents against themselves with @ written out: the lines that change."""
    c = on.table(spark, d, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", F.explode(diffs.changes(F.col("text"), F.regexp_replace("text", "@", " at "))).alias("c"))
    return c.groupBy("doc_id").agg(F.countDistinct("c.line").cast("long").alias("lines"))


@query()
def highlighted(spark, d):
    """Digits and mail addresses of documents between markers, their union where they overlap."""
    docs = on.table(spark, d, "documents")
    return transcripts.highlight(docs, transcripts.pattern_matches(docs, {"digits": "[0-9]{4,}", "mail": ["[a-z0-9.]+@[a-z0-9]+", "[a-z0-9]+@[a-z0-9.]+"]}, "doc_id"), "doc_id")


@query("SELECT o_orderkey AS session_id, o_orderkey % 3 = 0 AS active, CAST(o_orderkey % 4 AS INTEGER) AS commit_count, CASE WHEN o_orderkey % 3 = 0 THEN 500 ELSE 900 END AS duration_ms FROM orders")
def session_listing(spark, d):
    k = F.col("o_orderkey")
    rows = on.table(spark, d, "orders").select(k.alias("session_id"), F.when(k % 3 != 0, k * 1000 + 900).alias("end_time"), (k * 1000 + 500).alias("last_activity"), (k * 1000).alias("start_time"), F.array_repeat(F.lit("c"), (k % 4).cast("int")).alias("commits"))
    return filters.session_rows(rows).select("session_id", "active", "commit_count", "duration_ms")


@query("SELECT doc_id AS id, quality IS NOT NULL AS has_quality, CASE WHEN toxic = 1 THEN true ELSE false END AS has_toxic FROM documents LEFT JOIN labels USING (doc_id)")
def enrichment_flags(spark, d):
    rows = on.table(spark, d, "documents").select("doc_id").join(on.table(spark, d, "labels"), "doc_id", "left")
    return filters.enrichment_flags(rows.select(F.col("doc_id").alias("id"), "quality", F.when(F.col("toxic") == 1, 1).alias("toxic")), ["quality", "toxic"])


@query("SELECT c_custkey FROM customer WHERE c_custkey % 4 = 1 OR c_custkey % 7 = 2 OR c_nationkey = 3")
def changed_repos(spark, d):
    c, k = on.table(spark, d, "customer"), F.col("c_custkey")
    rows = c.withColumns({"staged": F.when(k % 4 == 1, 2), "untracked": F.when(k % 7 == 2, 1).otherwise(0), "rebase": F.when(F.col("c_nationkey") == 3, True)})
    return rows.where(filters.has_changes(["staged", "untracked"], ["rebase"])).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'e') OR contains(lower(p_brand), 'e') OR contains(lower(p_type), 'e')")
def metadata_search(spark, d):
    rows = on.table(spark, d, "part").withColumns({"name": F.col("p_name"), "aliases": F.array("p_brand"), "tags": F.array("p_type")})
    return rows.where(filters.metadata_search("E")).select("p_partkey")


@query("SELECT doc_id AS id FROM documents WHERE source IN ('src0', 'src1') AND n_chars BETWEEN 500 AND 5000 ORDER BY n_chars DESC, id LIMIT 50 OFFSET 10")
def index_page(spark, d):
    rows = on.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("agent"), F.col("n_chars").alias("modified_at"))
    return filters.index_query(rows, ["src0", "src1"], 500, 5000, offset=10, limit=50).select("id")


@query("""WITH f AS (SELECT source AS prefix, doc_id AS name, DATE '2024-03-01' - CAST(doc_id % 40 AS INTEGER) AS date FROM documents), o AS (SELECT *, date_diff('day', date, DATE '2024-03-01') > 30 AS old FROM f)
 SELECT name, old OR row_number() OVER (PARTITION BY prefix, old ORDER BY date DESC, name DESC) > 5 AS deleted FROM o""")
def log_rotation(spark, d):
    files = on.table(spark, d, "documents").select(F.col("source").alias("prefix"), F.col("doc_id").alias("name"), F.date_sub(F.lit("2024-03-01").cast("date"), (F.col("doc_id") % 40).cast("int")).alias("date"))
    return monitor.rotation(files, "2024-03-01", 30, 5).select("name", "deleted")


@query("SELECT event_id FROM events WHERE event_id % 10 = 0")
def sampled_scans(spark, d):
    return monitor.sampled(on.table(spark, d, "events").withColumn("scan", F.col("event_id"))).select("event_id")


@query("SELECT o_orderkey, CAST(least(60000, 5000 * pow(2, greatest(o_orderkey % 9 - 1, 0))) AS BIGINT) AS delay FROM orders")
def backoff(spark, d):
    return on.table(spark, d, "orders").select("o_orderkey", monitor.backoff_ms(F.col("o_orderkey") % 9).alias("delay"))


@query("""SELECT event_id, 'in,in[].a,k' AS paths FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'in,in.b,k' FROM events WHERE event_id % 2 = 1""")
def field_paths(spark, d):
    """Paths of two shapes of JSON: an array of objects, and an object."""
    k = F.get_json_object("props", "$.k")
    deep = F.concat(F.lit('{"k": '), k, F.when(F.col("event_id") % 2 == 0, ', "in": [{"a": 1}, {"c": 2}]}').otherwise(', "in": {"b": null}}'))
    return on.table(spark, d, "events").select("event_id", F.array_join(F.array_sort(redact.field_paths(deep)), ",").alias("paths"))


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"in":[{"a":' || (event_id % 10) || '}]}' AS kept, '{"in":[{"a":' || (event_id % 10) || ',"b":2}],"z":' || event_id || '}' AS stripped FROM events""")
def keep_and_strip(spark, d):
    i = F.col("event_id")
    deep = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "in": [{"a": '), (i % 10).cast("string"), F.lit(', "b": 2}], "z": '), i.cast("string"), F.lit("}"))
    return on.table(spark, d, "events").select("event_id", redact.keep_fields(deep, ["k", "in[]"], ["in.*.b"]).alias("kept"), redact.strip_fields(deep, ["k"]).alias("stripped"))


@query("""SELECT doc_id AS id FROM documents LEFT JOIN (SELECT DISTINCT doc_id AS l FROM labels) ON l = doc_id WHERE lang = 'en' AND source <> 'src0' AND contains(lower(substr(text, 1, 80)), 'the') AND l IS NOT NULL AND coalesce(CASE WHEN n_chars % 3 = 0 THEN 'ready' END, 'pending') = 'pending'""")
def contribution_list(spark, d):
    """Documents as contributions of their language's agent, named by their first 80 characters."""
    rows = on.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("session_id"), F.col("lang").alias("agent"), F.substring("text", 1, 80).alias("name"), F.col("source").alias("project_dir"), F.lit(None).cast("string").alias("cwd"), F.when(F.col("n_chars") % 3 == 0, "ready").alias("workflow_status"), F.col("n_chars").alias("modified_at"), F.col("n_chars").alias("size_bytes"))
    marked = on.table(spark, d, "labels").select(F.col("doc_id").alias("session_id"))
    return filters.contribution_list(rows.withColumn("id", F.col("id").cast("string")), "en", [f"src{k}" for k in range(1, 20)], " THE ", marked, "pending", "largest").select(F.col("id").cast("long").alias("id"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def managed_list(spark, d):
    m = on.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"), F.col("o_orderpriority").alias("agent"), F.col("o_orderdate").alias("started_at"))
    return filters.managed_list(m, True, "1-URGENT", 25).select("id")


@query("SELECT lang AS agent, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM documents")
def index_stats(spark, d):
    return stats.index_stats(on.table(spark, d, "documents").select(F.col("lang").alias("agent")))


@query("""WITH f AS (SELECT doc_id, unnest(list_filter(['lang', 'source', 'text'], lambda x: (x = 'lang' AND n_chars % 2 = 0) OR (x = 'source' AND n_chars % 3 = 0) OR (x = 'text' AND n_chars < 0))) AS field FROM documents)
 SELECT count(*) AS sessions, CAST(sum(n_chars % 5) AS BIGINT) AS redactions, floor(avg(n_chars % 101) * 10 + 0.5) / 10 AS mean_score, (SELECT count(DISTINCT field) FROM f) AS fields_stripped FROM documents""")
def preparation_stats(spark, d):
    n = F.col("n_chars")
    fields = F.array_compact(F.array(F.when(n % 2 == 0, "lang"), F.when(n % 3 == 0, "source"), F.when(n < 0, "text")))
    return stats.preparation_stats(on.table(spark, d, "documents").select((n % 101).alias("score"), (n % 5).alias("redactions"), fields.alias("stripped_fields")))


CALLS = """WITH t AS (SELECT page_id AS id, octet_length(encode(html)) AS size_bytes, regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '([^/]+)/[^/]*$', 1) AS project, list_value('Read', 'Write', 'Edit', 'Read')[octet_length(encode(html)) % 4 + 1] AS tool_name FROM pages) """


def _page_calls(spark, d):
    size, folder = F.octet_length("html").cast("long"), F.regexp_extract("url", "^([^?#]*)/[^/?#]*", 1)
    pages = on.table(spark, d, "pages").select(F.col("page_id").alias("id"), size.alias("size_bytes"), folder.alias("project_dir"), "url")
    calls = pages.select(F.col("id").alias("transcript_id"), F.element_at(F.array(*map(F.lit, ["Read", "Write", "Edit", "Read"])), (F.col("size_bytes") % 4 + 1).cast("int")).alias("tool_name"), F.col("url").alias("file_path"))
    return pages, calls


@query(CALLS + """SELECT count(*) AS transcripts, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, CAST(floor(sum(size_bytes) / 1048576 + 0.5) AS BIGINT) AS size_mb, count(*) FILTER (tool_name = 'Read') AS reads, count(*) FILTER (tool_name = 'Write') AS writes, count(*) FILTER (tool_name = 'Edit') AS edits FROM t""")
def corpus_totals(spark, d):
    """Pages as transcripts, each with a call by the size of its html."""
    return transcripts.corpus_totals(*_page_calls(spark, d))


@query(CALLS + """SELECT CASE WHEN project = '' THEN 'unknown' ELSE project END AS project, count(*) AS transcripts, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, count(*) FILTER (tool_name = 'Read') AS reads FROM t GROUP BY 1 ORDER BY size_bytes DESC, project LIMIT 20""")
def top_projects(spark, d):
    return transcripts.top_projects(*_page_calls(spark, d))


@query("""WITH d AS (SELECT conv_id, turn, length(text) % 101 AS o, length(text) % 97 AS a, length(text) % 89 AS b, length(text) % 83 AS c, length(text) % 79 AS e, role FROM conversations),
 k AS (SELECT *, CASE WHEN o >= 80 THEN 'excellent' WHEN o >= 60 THEN 'good' WHEN o >= 40 THEN 'fair' WHEN o > 0 THEN 'poor' ELSE 'unknown' END AS class,
 concat_ws(', ', CASE WHEN a >= 70 THEN 'task completed' END, CASE WHEN b >= 70 THEN 'good code quality' END, CASE WHEN c >= 70 THEN 'efficient workflow' END, CASE WHEN e >= 70 THEN 'safe operations' END) AS s,
 concat_ws(', ', CASE WHEN a < 40 THEN 'task may be incomplete' END, CASE WHEN b < 40 THEN 'code quality issues' END, CASE WHEN c < 40 THEN 'inefficient workflow' END, CASE WHEN e < 40 THEN 'safety concerns' END) AS w FROM d)
 SELECT conv_id, turn, concat_ws('. ', upper(class[1]) || class[2:] || ' (' || o || '/100)', CASE WHEN s <> '' THEN 'Strengths: ' || s END, CASE WHEN w <> '' THEN 'Areas to improve: ' || w END) AS description,
 CASE class WHEN 'excellent' THEN 'green' WHEN 'good' THEN 'blue' WHEN 'fair' THEN 'yellow' WHEN 'poor' THEN 'red' ELSE 'gray' END AS color FROM k""")
def score_descriptions(spark, d):
    """Turns of conversations with scores by the length of their text."""
    n = F.length("text")
    cls = quality.classify(n % 101)
    rows = on.table(spark, d, "conversations")
    return rows.select("conv_id", "turn", quality.describe(n % 101, cls, completion=n % 97, code_quality=n % 89, efficiency=n % 83, safety=n % 79).alias("description"), quality.class_color(cls).alias("color"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
 b AS (SELECT conv_id, k, n, CASE role WHEN 'user' THEN '👤' WHEN 'assistant' THEN '🤖' ELSE '📝' END || upper(role[1]) || role[2:] || ' ' || printf('%02d:%02d', turn % 24, conv_id % 60)
 || CASE WHEN trim(replace(substr(text, 1, 60), chr(10), ' ')) <> '' THEN chr(10) || '  ' || trim(replace(substr(text, 1, 60), chr(10), ' ')) || CASE WHEN length(text) > 60 THEN '...' ELSE '' END ELSE '' END || chr(10) AS block FROM r WHERE k <= 3)
 SELECT conv_id AS transcript_id, substr(string_agg(block, chr(10) ORDER BY k) || CASE WHEN any_value(n) > 3 THEN chr(10) || '... and ' || (any_value(n) - 3) || ' more messages' ELSE '' END, 1, 250) AS preview FROM b GROUP BY 1""")
def chat_previews(spark, d):
    """The first three turns of each conversation, with times made of their numbers."""
    c = on.table(spark, d, "conversations")
    time = F.format_string("2024-01-01 %02d:%02d:00", F.col("turn") % 24, F.col("conv_id") % 60)
    rows = c.select(F.col("conv_id").alias("transcript_id"), F.col("turn").alias("line"), "role", F.col("text").alias("content"), time.alias("timestamp"))
    return transcripts.chat_previews(rows, 3, 60, 250)
