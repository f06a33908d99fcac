"""Links between independently recorded sources."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import release, written


def pair_calls(pre: DataFrame, post: DataFrame) -> DataFrame:
    """Begun calls with their ends: duration and success, null while open; ends without a begin are left out."""
    ends = post.select("tool_use_id", F.col("timestamp").alias("completed_at"), "error")
    out = pre.join(ends, "tool_use_id", "left")
    return out.withColumns({"duration_ms": F.col("completed_at") - F.col("timestamp"), "success": F.when(F.col("completed_at").isNotNull(), F.col("error").isNull())})


def by_path(hooks: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Hook sessions with the transcript of the same path; of equal paths the last transcript counts."""
    newest = transcripts.where("path <> ''").groupBy("path").agg(F.max_by(F.struct(*transcripts.columns), F.col("pos")).alias("t"))
    return hooks.join(newest, hooks["transcript_path"] == newest["path"]).select(hooks["*"], F.col("t.transcript_id").alias("transcript_id"))


def match_score(gap_ms: Column, window_ms: int, same_cwd: Column, near_cwd: Column, same_tools: Column) -> Column:
    """Points of a candidate pair: time 30 or 15, working directory 25 or 10, tool count 5."""
    time = F.when(gap_ms <= window_ms, 30).when(gap_ms <= 2 * window_ms, 15).otherwise(0)
    return time + F.when(same_cwd, 25).when(near_cwd, 10).otherwise(0) + F.when(same_tools, 5).otherwise(0)


def prefixes_among(strings: DataFrame, among: DataFrame, column: str, proper: bool = True) -> DataFrame:
    """(column, prefix): each distinct string of ``strings`` with all its prefixes that stand in ``among`` (prefix).

    A trie by equality: a string is cut at the lengths that occur in ``among`` (as many as its longest string is long),
    and the cuts are joined. No order is compared and no pair of strings is made that does not share the prefix. Null
    strings take no part. ``proper``: a string is no prefix of itself.
    """
    nodes = among.select("prefix").where("prefix is not null").distinct()
    sizes = [r[0] for r in nodes.select(F.length("prefix").alias("n")).distinct().collect()]  # at most the longest string's length
    size = F.length(column)
    own = strings.select(column).distinct()
    cuts = F.filter(F.array(*map(F.lit, sorted(sizes))).cast("array<int>"), lambda n: n < size if proper else n <= size)
    return own.select(column, F.explode(F.transform(cuts, lambda n: F.substring(column, F.lit(1), n))).alias("prefix")).join(nodes, "prefix").select(column, "prefix")


def candidates(hooks: DataFrame, transcripts: DataFrame, window_ms: int = 5_000, least: int = 40) -> DataFrame:
    """hooks (hook_id, hook_pos, start, cwd), transcripts (transcript_id, transcript_pos, t_start, t_cwd): pairs of ``least`` points.

    Directories are related if one is a plain prefix of the other (``/w/1`` of ``/w/12`` too); empty and null ones are
    not. Of ``least`` points, 36 or more, a pair always has some for its directory, so pairs meet by directory and
    bucket of time: under the same one, or where one side's is a prefix (a node of the trie of the other side's). Where
    there are tool_calls (of a hook) and message_count (of a transcript), a count of messages from one to five times
    that of calls gives its points too.
    """
    if least < 36:
        raise ValueError("below 36 points a pair needs no directory, and would have to meet by time alone")
    width = 2 * window_ms
    h, t = hooks.where("cwd <> ''"), transcripts.where("t_cwd <> ''")
    above_h = prefixes_among(h, t.select(F.col("t_cwd").alias("prefix")), "cwd").groupBy("cwd").agg(F.collect_list("prefix").alias("above"))
    above_t = prefixes_among(t, h.select(F.col("cwd").alias("prefix")), "t_cwd").groupBy("t_cwd").agg(F.collect_list("prefix").alias("above"))
    own = lambda c, *kinds: F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("node")) for k in kinds])
    up = lambda k: F.coalesce(F.transform("above", lambda p: F.struct(F.lit(k).alias("kind"), p.alias("node"))), F.array().cast("array<struct<kind:string,node:string>>"))
    near = lambda c: F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(c) / width) + d))
    dealt_h = h.join(above_h, "cwd", "left").withColumn("at", F.explode(F.concat(own("cwd", "same", "below"), up("above")))).drop("above").withColumn("bucket", near("start"))
    dealt_t = t.join(above_t, "t_cwd", "left").withColumn("at", F.explode(F.concat(own("t_cwd", "same", "above"), up("below")))).drop("above").withColumn("bucket", F.floor(F.col("t_start") / width))
    counted = "tool_calls" in hooks.columns and "message_count" in transcripts.columns
    same_tools = F.col("message_count").between(F.col("tool_calls"), F.col("tool_calls") * 5) if counted else F.lit(False)
    score = match_score(F.abs(F.col("start") - F.col("t_start")), window_ms, F.col("at.kind") == "same", F.lit(True), same_tools)
    return dealt_h.join(dealt_t, ["at", "bucket"]).withColumn("score", score).where(F.col("score") >= least).drop("at", "bucket")


#: pairs that a task goes through in one round of ``greedy_match``
BLOCK_PAIRS = 250_000


def greedy_match(pairs: DataFrame, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One transcript per hook: hooks in order each take their best free transcript (the first among equals).

    Rounds of reservations. The open pairs are dealt to blocks of consecutive hooks, whatever group they belong to. A
    task goes through its block in order; a hook takes its best transcript if that is certainly free: not taken in the
    block, in no open pair of an earlier block, and not among those that an undecided hook before it may take. All that
    commit leave with their transcripts. The first block is decided whole in each round, and others but for what hangs
    on earlier ones, so blocks that meet at few transcripts take few rounds; at worst, a chain through all blocks takes
    as many rounds as there are blocks. A task holds the ids of a block only. The result is that of going through all
    hooks one by one. Ids are not null; equal pairs count once.
    """
    chosen, open_ = [], written(pairs, "open-pairs")
    while n := open_.count():
        placed = written(open_.repartitionByRange(-(-n // block_pairs), "hook_pos", "hook_id").withColumn("block", F.spark_partition_id()), "placed-pairs")
        won = written(_reserved(placed).select(*pairs.columns), "matched-pairs")
        left = open_.join(won.select("hook_id"), "hook_id", "left_anti").join(won.select("transcript_id"), "transcript_id", "left_anti")
        left = written(left.select(*pairs.columns), "open-pairs")
        release(open_, placed)
        chosen.append(won)
        open_ = left
    release(open_)
    out = pairs.sparkSession.createDataFrame([], pairs.schema)
    for won in chosen:
        out = out.unionByName(won)
    return out


def _reserved(placed: DataFrame) -> DataFrame:
    """The pairs that the hooks of each block certainly take."""
    first = placed.groupBy("transcript_id").agg(F.min("block").alias("first_block"))
    rows = placed.join(first, "transcript_id").withColumn("earlier", F.col("first_block") < F.col("block")).drop("first_block")

    def run(batches):
        block, hook, taken, unsure = None, None, set(), set()
        done = waits = False
        for batch in batches:
            keep = []
            for b, h, t, earlier in zip(*(batch.column(c).to_pylist() for c in ("block", "hook_id", "transcript_id", "earlier"))):
                if b != block:
                    block, hook, taken, unsure = b, None, set(), set()
                if h != hook:
                    hook, done, waits = h, False, False
                commits = False
                if not done and t not in taken:
                    if earlier or t in unsure:
                        waits = True
                    else:
                        done, commits = True, not waits
                    if commits:
                        taken.add(t)
                    else:
                        unsure.add(t)  # the hook may take it, or one before it
                keep.append(commits)
            yield batch.filter(pa.array(keep, pa.bool_()))

    blocks = placed.select(F.max("block")).first()[0] + 1
    ordered = rows.repartition(blocks, "block").sortWithinPartitions("block", "hook_pos", "hook_id", F.col("score").desc(), "transcript_pos", "transcript_id")
    return ordered.mapInArrow(run, ordered.schema)


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def correlation_stats(rows: DataFrame) -> DataFrame:
    """Rows by match type, and rows with each side."""
    return rows.groupBy("match_type").agg(F.count("*").alias("n"), F.count("hook_id").alias("with_hook"), F.count("transcript_id").alias("with_transcript"))


def attach_in_range(spans: DataFrame, points: DataFrame, key: str, bucket_ms: int = 3_600_000) -> DataFrame:
    """spans (key, span_id, begin, finish) with points (key, at): pairs where begin <= at <= finish."""
    s = spans.withColumns({"l_begin": F.col("begin"), "l_end": F.col("finish")})
    p = points.withColumns({"r_begin": F.col("at"), "r_end": F.col("at")})
    return overlapping(s, p, key, bucket_ms).drop("l_begin", "l_end", "r_begin", "r_end")


def overlapping(left: DataFrame, right: DataFrame, key: str, bucket_ms: int = 3_600_000) -> DataFrame:
    """left (key, l_begin, l_end), right (key, r_begin, r_end): pairs of one key whose intervals overlap.

    Pairs meet by key and bucket of time. Buckets come in levels, each twice as wide as the one before; an interval
    belongs to the level at which it touches two buckets at most and a pair meets at the higher of its two levels, so
    neither a key with very many intervals nor an open-ended one makes more pairs than overlap or stand close by.
    """

    def leveled(rows: DataFrame, side: str) -> DataFrame:
        length = (F.col(f"{side}_end") - F.col(f"{side}_begin") + 1) / F.lit(float(bucket_ms))
        return rows.where(F.col(f"{side}_end") >= F.col(f"{side}_begin")).withColumn(f"{side}_level", F.greatest(F.lit(0), F.ceil(F.log2(length))).cast("int"))

    def dealt(rows: DataFrame, side: str) -> DataFrame:
        met = rows.withColumn("level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda v: v >= F.col(f"{side}_level"))))
        width = F.pow(F.lit(2.0), F.col("level")) * bucket_ms
        return met.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(f"{side}_begin") / width), F.floor(F.col(f"{side}_end") / width))))

    left, right = leveled(left, "l"), leveled(right, "r")
    levels = sorted(r[0] for r in left.select("l_level").union(right.select("r_level")).distinct().collect())  # at most 64
    if not levels:
        return left.join(right, key).drop("l_level", "r_level")
    later = F.floor(F.greatest("l_begin", "r_begin") / (F.pow(F.lit(2.0), F.col("level")) * bucket_ms))
    met = dealt(left, "l").join(dealt(right, "r"), [key, "level", "bucket"])
    kept = met.where((F.col("level") == F.greatest("l_level", "r_level")) & (F.col("bucket") == later) & (F.col("l_begin") <= F.col("r_end")) & (F.col("r_begin") <= F.col("l_end")))
    return kept.drop("level", "bucket", "l_level", "r_level")


def resolve_project(rows: DataFrame, projects: DataFrame, path: str, home: str | None = None) -> DataFrame:
    """The first project (by position) whose path is the row's path or a directory above it.

    The row's path is cut into its ancestors and joined by equality, so no product of the two tables is made. With
    ``home``, a ``~`` that begins a path on either side stands for it.
    """
    at = "_at"
    p = projects.withColumn("project_path", _at_home(F.col("project_path"), home)).groupBy("project_path").agg(F.min(F.struct("project_pos", "project_id")).alias("p"))
    own = rows.withColumn(at, F.when(F.col(path) != "", _at_home(F.col(path), home)))
    found = _ancestors(own, at, "project_path").join(p, "project_path").groupBy(at).agg(F.min("p").getField("project_id").alias("project_id"))
    return own.join(found, at, "left").drop(at)


def _at_home(path: Column, home: str | None) -> Column:
    """The path with a leading ``~`` as ``home``, and without a slash at its end."""
    out = path if home is None else F.when(path.startswith("~"), F.concat(F.lit(home), F.regexp_replace(path, "^~", ""))).otherwise(path)
    return F.regexp_replace(out, "/$", "")


def first_prefix(rows: DataFrame, projects: DataFrame, path: str) -> DataFrame:
    """The first project (project_pos, path_pos) one of whose paths is a plain prefix of the row's: ``/w/1`` of ``/w/12``.

    Priority on the trie of ``prefixes_among``: the paths that are prefixes of a string are joined, and the smallest
    position among them wins. An empty project path fits every path, a null path fits none.
    """
    p = projects.groupBy(F.col("project_path").alias("prefix")).agg(F.min(F.struct("project_pos", "path_pos", "project_id")).alias("p"))
    found = prefixes_among(rows.where(F.col(path).isNotNull()), p, path, proper=False).join(p, "prefix").groupBy(path).agg(F.min("p").getField("project_id").alias("project_id"))
    return rows.join(found, path, "left")


def _ancestors(rows: DataFrame, path: str, name: str) -> DataFrame:
    """Each distinct path with itself and all directories above it."""
    parts = F.split(F.col(path), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda d: F.array_join(F.slice(parts, 1, d), "/"))
    return rows.select(path).distinct().where(F.col(path).isNotNull()).select(path, F.explode(up).alias(name))


def longest_prefix(rows: DataFrame, prefixes: DataFrame, path: str) -> DataFrame:
    """The longest listed path that is the row's path or above it; null if none."""
    keys = _ancestors(rows, path, "prefix")
    best = keys.join(prefixes.select("prefix").distinct(), "prefix").groupBy(path).agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return rows.join(best, path, "left")


def prioritized_lookup(rows: DataFrame, table: DataFrame, keys: list[str], value: str, order: str | None = None) -> DataFrame:
    """The table's value under the first of several keys that it holds.

    Of a repeated key the value last by ``order`` counts (without it the greatest), so no row comes twice. Each row asks
    for all its keys in one join, from which it takes the answer to the first.
    """
    last = table.where("key is not null").groupBy("key").agg(F.max_by(value, order) if order else F.max(value)).toDF("_key", "_value")
    asked = rows.select(F.array(*keys).alias("_keys")).distinct()
    requests = asked.select("_keys", F.posexplode("_keys").alias("_k", "_key"))
    answers = requests.join(last.where("_value is not null"), "_key").groupBy("_keys").agg(F.min_by("_value", "_k").alias(value))
    return rows.drop(value).withColumn("_keys", F.array(*keys)).join(answers.withColumnRenamed("_keys", "_asked"), F.col("_keys").eqNullSafe(F.col("_asked")), "left").drop("_keys", "_asked")


def merge_timeline(*sources: DataFrame) -> DataFrame:
    """Entries of several sources in one list; sort it by (timestamp, source, entry_id)."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def catalog_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, change: added, updated (newer modified_at), unchanged or removed; discovered_at is kept."""
    o = old.select("id", F.col("modified_at").alias("was"), "discovered_at")
    n = new.select("id", "modified_at")
    change = F.when(F.col("was").isNull(), "added").when(F.col("modified_at").isNull(), "removed").when(F.col("modified_at") > F.col("was"), "updated").otherwise("unchanged")
    return o.join(n, "id", "full").select("id", change.alias("change"), "modified_at", "discovered_at")


def infer_projects(repos: DataFrame, known: DataFrame) -> DataFrame:
    """Repositories (path, name) whose path is not yet known, in order of path, each with a new id out of its name.

    known (path, project_id). The id is the name in lower case with dashes for other characters, none at the ends. While
    it is in use, -1, -2, ... are added to what there is: a, a-1, a-1-2, a-1-2-3. Such ids belong to one family, so
    families are gone through apart, many in a task, and each name goes on behind its last id. A missing name is the last part of the path; without either there is no project.
    """
    name = F.coalesce(F.nullif("name", F.lit("")), F.try_element_at(F.filter(F.split("path", "/"), lambda x: x != ""), F.lit(-1)))
    fresh = repos.groupBy("path").agg(F.max("name").alias("name")).join(known.select("path"), "path", "left_anti").withColumn("name", name).where("name is not null")
    slug = F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-|-$", "")
    taken = known.select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("name"), F.col("project_id").cast("string").alias("slug")).where("slug is not null").distinct()
    rows = fresh.select("path", "name", slug.alias("slug")).unionByName(taken)
    rows = rows.withColumn("family", F.regexp_replace("slug", "(-[0-9]+)+$", ""))
    rows = rows.withColumn("longest", F.max(F.length("slug")).over(Window.partitionBy("family")))

    def run(batches):
        family, used, following = None, set(), {}
        for batch in batches:
            out, size = [], 0
            for path, name, slug, of, longest in zip(*(batch.column(c).to_pylist() for c in ("path", "name", "slug", "family", "longest"))):
                if of != family:
                    family, used, following = of, set(), {}
                if path is None:
                    used.add(slug)
                    continue
                project, suffix = following.get(slug, (slug, 1))
                while project in used:
                    project, suffix = f"{project}-{suffix}", suffix + 1
                if len(project) <= longest:  # longer ones are met again only by their own slug, which goes on behind them
                    used.add(project)
                following[slug] = f"{project}-{suffix}", suffix + 1
                out.append((path, name, project))
                size += len(project)
                if size > 8_000_000:
                    yield made(out)
                    out, size = [], 0
            if out:
                yield made(out)

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], names=["path", "name", "project_id"])

    # ids in use come first (their path is null), then the repositories in order of path
    return rows.repartition("family").sortWithinPartitions("family", "path").mapInArrow(run, "path string, name string, project_id string")


def live_pids(sessions: DataFrame, processes: DataFrame, label: str = "claude") -> DataFrame:
    """Sessions with the pid of the live agent in their folder; of several the last by position."""
    last = processes.where(F.col("label") == label).groupBy("cwd").agg(F.max_by("pid", "pos").alias("live_pid"))
    return sessions.join(last, "cwd", "left")


def bulk_get(ids: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """A row per asked id, found or not; ``found`` tells which. Of rows of the table with one key the greatest counts."""
    rest = [c for c in table.columns if c != key]
    once = table.groupBy(key).agg(F.max(F.struct(*rest)).alias("_row")).select(key, "_row.*")
    return ids.join(once.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def attach_managed(conversations: DataFrame, managed: DataFrame, hour_ms: int = 3_600_000) -> DataFrame:
    """conversation_id, managed_id, how: by pid (the last managed session of a pid, also for several conversations),
    then one to one by folder and overlap in time; managed sessions left over stand alone."""
    m = managed.select(F.col("id").alias("managed_id"), F.col("pid").alias("m_pid"), F.col("cwd").alias("m_cwd"), F.col("started_at").alias("r_begin"), F.coalesce("ended_at", F.col("started_at") + hour_ms).alias("r_end"))
    last = m.where("m_pid is not null").groupBy("m_pid").agg(F.max_by("managed_id", F.struct("r_begin", "managed_id")).alias("managed_id"))
    c = conversations.select("conversation_id", "pid", "cwd", F.col("start_time").alias("l_begin"), F.coalesce("end_time", F.col("start_time") + hour_ms).alias("l_end"))
    by_pid = c.join(last, c["pid"] == last["m_pid"]).select("conversation_id", "managed_id", F.lit("pid").alias("how"))
    # written, as the levels of overlaps are counted before the pairs are made
    free_c, free_m = written(unmatched(c, by_pid, "conversation_id"), "free-conversations"), written(unmatched(m, by_pid, "managed_id"), "free-managed")
    near = overlapping(free_c, free_m.withColumnRenamed("m_cwd", "cwd"), "cwd")
    pairs = near.select(F.col("conversation_id").alias("hook_id"), F.struct("l_begin", "conversation_id").alias("hook_pos"), F.col("managed_id").alias("transcript_id"), F.struct("r_begin", "managed_id").alias("transcript_pos"), F.lit(1).alias("score"))
    by_time = greedy_match(pairs).select(F.col("hook_id").alias("conversation_id"), F.col("transcript_id").alias("managed_id"), F.lit("time").alias("how"))
    release(free_c, free_m)
    linked = by_pid.unionByName(by_time)
    alone = unmatched(m, linked, "managed_id").select(F.lit(None).cast(c.schema["conversation_id"].dataType).alias("conversation_id"), "managed_id", F.lit("alone").alias("how"))
    return linked.unionByName(alone)
