"""Filters, listings, paging and projections over the typed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules


def event_feed(events: DataFrame, category: str | None = None, action: str | None = None, since: str | None = None, limit: int = 50) -> DataFrame:
    """The newest events of a category, action and time; equal times in order of id."""
    for column, value in (("category", category), ("action", action)):
        if value is not None:
            events = events.where(F.col(column) == value)
    if since is not None:
        events = events.where(F.col("timestamp") >= since)
    return events.orderBy(F.col("timestamp").desc(), "id").limit(limit)


def audit_page(events: DataFrame, since: str | None = None, until: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
    if since is not None:
        events = events.where(F.col("timestamp") >= since)
    if until is not None:
        events = events.where(F.col("timestamp") <= until)
    return events.orderBy(F.col("timestamp").desc(), "id").offset(offset).limit(limit)


def index_query(catalog: DataFrame, agents: list[str] | None = None, since: int | None = None, until: int | None = None, newest: bool = True, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Catalog entries by agent and time; the offset counts before the limit."""
    if agents:
        catalog = catalog.where(F.col("agent").isin(agents))
    if since is not None:
        catalog = catalog.where(F.col("modified_at") >= since)
    if until is not None:
        catalog = catalog.where(F.col("modified_at") <= until)
    at = F.col("modified_at")
    out = catalog.orderBy(at.desc() if newest else at.asc(), "id").offset(offset)
    return out if limit is None else out.limit(limit)


def conversation_filter(match_type=None, feedback=None, task_type=None, quality=None, agent=None, has_hooks=None, managed=None, has_quality=None, workflow=None, project=None, search=None) -> Column:
    """One predicate of up to eleven conditions; feedback 'unlabeled' means none; quality is [least, most)."""
    tests = []
    for name, value in (("match_type", match_type), ("task_type", task_type), ("agent", agent)):
        if value is not None:
            tests.append(F.col(name) == value)
    if feedback is not None:
        tests.append(F.col("feedback").isNull() if feedback == "unlabeled" else F.col("feedback") == feedback)
    if quality is not None:
        tests.append((F.col("score") >= quality[0]) & (F.col("score") < quality[1]))
    for name, value in (("hook_id", has_hooks), ("managed_id", managed), ("score", has_quality)):
        if value is not None:
            tests.append(F.col(name).isNotNull() if value else F.col(name).isNull())
    if workflow is not None:
        tests.append(F.coalesce("workflow_status", F.lit("pending")) == workflow)
    if project is not None:
        tests.append((F.col("cwd") == project) | F.col("cwd").startswith(project + "/"))
    if search is not None:
        tests.append(reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(search.lower()), F.lit(False)) for c in ("name", "cwd", "agent", "id")]))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def conversation_order(by: str = "time") -> list[Column]:
    return [F.coalesce("score", F.lit(0)).desc(), F.col("id")] if by == "quality" else [F.col("start_time").desc(), F.col("id")]


def contribution_order(by: str = "newest") -> list[Column]:
    """newest, oldest, smallest (unknown sizes last) or largest (unknown sizes as 0)."""
    keys = {"newest": F.col("modified_at").desc(), "oldest": F.col("modified_at").asc(), "smallest": F.col("size_bytes").asc_nulls_last(), "largest": F.coalesce("size_bytes", F.lit(0)).desc()}
    return [keys[by], F.col("id")]


def predictions_with_outcomes(predictions: DataFrame, outcomes: DataFrame, has_outcome: bool | None = None) -> DataFrame:
    out = predictions.join(outcomes, "prediction_id", "left")
    return out if has_outcome is None else out.where(F.col("recorded_at").isNotNull() if has_outcome else F.col("recorded_at").isNull())


def has_changes(counts: list[str], states: list[str]) -> Column:
    """A repository with counted files or in one of the states."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in counts] + [F.coalesce(F.col(c), F.lit(False)) for c in states])


def metadata_search(text: str) -> Column:
    """Substring of a name, of any alias or of any tag."""
    inside = lambda c: F.lower(c).contains(text.lower())
    return inside(F.col("name")) | F.exists("aliases", inside) | F.exists("tags", inside)


def match_process(cmdline: Column, exe: Column, matchers: list[dict], wrappers: list[str] = tuple(rules.SHELL_WRAPPERS)) -> Column:
    """The label of the first matcher that fits; wrapper commands have none. Matchers: label, kind, pattern."""
    out = F.when(reduce(lambda a, b: a | b, [cmdline.rlike(w) | exe.rlike(w) for w in wrappers], F.lit(False)), None)
    for m in matchers:
        test = {"cmd_regex": cmdline.rlike("(?i)" + m["pattern"]), "exe_prefix": exe.startswith(m["pattern"]), "exe_suffix": exe.endswith(m["pattern"])}[m["kind"]]
        out = out.when(test, m["label"])
    return out


def session_rows(sessions: DataFrame) -> DataFrame:
    """Sessions with the derived columns that listings show."""
    return sessions.withColumns({"active": F.col("end_time").isNull(), "commit_count": F.size("commits"), "duration_ms": F.coalesce("end_time", "last_activity") - F.col("start_time")})


def enrichment_flags(rows: DataFrame, columns: list[str]) -> DataFrame:
    """has_<column> for each enrichment of a wide table."""
    return rows.select("id", *[F.col(c).isNotNull().alias(f"has_{c}") for c in columns])


def retained(rows: DataFrame, as_of: int, keep_days: int, most: int, order: str = "timestamp") -> DataFrame:
    """Rows younger than ``keep_days``, of these the newest ``most``."""
    return rows.where(F.col(order) >= as_of - keep_days * 86_400_000).orderBy(F.col(order).desc(), "id").limit(most)


def contribution_list(rows: DataFrame, agent: str | None = None, project_paths: list[str] | None = None, search: str | None = None, annotations: DataFrame | None = None, workflow: str | None = None, by: str = "newest") -> DataFrame:
    """Contributions (id, session_id, agent, name, project_dir, cwd, workflow_status, modified_at, size_bytes) that pass, in order.

    A project is its paths, with what lies below them. The search is for a part of the name, folder or ids, whatever
    the case, blanks around it aside. ``annotations`` (session_id) keeps the annotated ones. A row without a workflow
    status is pending.
    """
    out = rows
    if agent is not None:
        out = out.where(F.col("agent") == agent)
    if project_paths is not None:
        folder = F.coalesce(F.nullif("project_dir", F.lit("")), F.col("cwd"), F.lit(""))
        inside = [(folder == p) | folder.startswith(p + "/") for p in project_paths]
        out = out.where(reduce(lambda a, b: a | b, inside, F.lit(False)))
    if search is not None and search.strip():
        wanted = F.lit(search.strip().lower())
        out = out.where(F.coalesce(*[F.when(F.contains(F.lower(c), wanted), True) for c in ("name", "project_dir", "id", "session_id")], F.lit(False)))
    if annotations is not None:
        out = out.join(annotations.select("session_id").where(F.col("session_id").cast("string") != "").distinct(), "session_id", "left_semi")
    if workflow is not None:
        out = out.where(F.coalesce(F.nullif("workflow_status", F.lit("")), F.lit("pending")) == workflow)
    return out.orderBy(*contribution_order(by))


def managed_list(sessions: DataFrame, active: bool = False, agent: str | None = None, limit: int | None = None) -> DataFrame:
    """Managed sessions, the newest first; with ``active`` only those that run."""
    out = sessions.where("status = 'running'") if active else sessions
    out = out if agent is None else out.where(F.col("agent") == agent)
    out = out.orderBy(F.col("started_at").desc(), "id")
    return out if limit is None else out.limit(limit)
