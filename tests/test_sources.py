"""Readers, writers and streaming counterparts on small files."""

import json
import sqlite3

from pyspark.sql import functions as F

from tracewell.sources import changelog, logs, sinks, zips
from tracewell.streaming import ingest, live


def put(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def test_bad_lines_and_missing_paths(spark, tmp_path):
    p = put(tmp_path / "e.jsonl", {"id": "1", "timestamp": "t"}, "", "{broken", {"id": "2"})
    assert sorted(r.id for r in logs.read_jsonl(spark, p, logs.EVENT).collect()) == ["1", "2"]
    assert logs.read_jsonl(spark, str(tmp_path / "none"), logs.EVENT).count() == 0


def test_partitions(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0), ("b", 86_400_000), ("c", 172_800_000)], "id string, timestamp long")
    sinks.append_log(rows, str(tmp_path / "log"))
    got = logs.read_partitioned(spark, str(tmp_path / "log"), "id string, timestamp long", start="1970-01-02")
    assert {r.id for r in got.collect()} == {"b", "c"}
    assert [r.id for r in logs.read_partitioned(spark, str(tmp_path / "log"), "id string, timestamp long", end="1970-01-02", limit=1).collect()] == ["b"]


def test_last_version_wins(spark):
    log = spark.createDataFrame([("a", 10, "d1", 1, 1), ("a", 10, "d1", 2, 2), ("b", 5, "d1", 3, 3), ("a", 10, "d0", 9, 4)], "session_id string, start_time long, dt string, line int, v int")
    assert {(r.session_id, r.v) for r in logs.hook_sessions(log, 5).collect()} == {("a", 2), ("b", 3)}
    assert {r.session_id for r in logs.hook_sessions(log, 5, strict=True).collect()} == {"a"}


def test_transcripts_of_three_vendors(spark):
    claude = [
        {"type": "summary", "summary": "old"}, {"type": "summary", "summary": "Name"}, {"type": "user", "message": {"role": "user", "content": "hi"}, "timestamp": "t1", "uuid": "u1"},
        {"type": "assistant", "message": {"role": "assistant", "model": "m", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "yo"}, {"type": "tool_use", "name": "Bash", "input": {"command": "ls"}}], "usage": {"input_tokens": 1000, "output_tokens": 200}}},
        {"type": "assistant", "message": {"content": "x", "usage": {"input_tokens": 300, "output_tokens": 50}}, "isSidechain": True},
    ]
    lines = spark.createDataFrame([("t", i, json.dumps(x)) for i, x in enumerate(claude)] + [("t", 9, "broken")], "transcript_id string, line int, value string")
    got = logs.parse_claude(lines).orderBy("line").collect()
    assert [(r.name, r.role, r.content, r.tool_name, r.is_sidechain) for r in got] == [("Name", "user", "hi", None, False), ("Name", "assistant", "hm\nyo", "Bash", False), ("Name", "assistant", "x", None, True)]
    assert (sum(r.input_tokens for r in got), sum(r.output_tokens for r in got)) == (1300, 250)
    codex = [{"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"text": "a"}, {"text": "b"}]}}, {"type": "response_item", "payload": {"type": "other"}}, {"type": "event"}]
    got = logs.parse_codex(spark.createDataFrame([("t", i, json.dumps(x)) for i, x in enumerate(codex)], "transcript_id string, line int, value string")).collect()
    assert [(r.role, r.content) for r in got] == [("user", "a\nb")]
    gemini = {"messages": [{"id": "1", "type": "user", "content": "q"}, {"type": "gemini", "content": "a", "thoughts": [{"x": 1}]}]}
    got = logs.parse_gemini(spark.createDataFrame([("t", json.dumps(gemini))], "transcript_id string, value string")).orderBy("line").collect()
    assert [(r.message_id, r.role, r.subtype) for r in got] == [("1", "user", None), ("1", "assistant", "thinking")]


def test_catalog(spark, tmp_path):
    put(tmp_path / ".claude" / "x" / "one.jsonl", "{}", "{}", "")
    put(tmp_path / ".codex" / "two.jsonl", "{}")
    # folders whose own name starts with a dot are listed when they are the root of a catalog
    both = [logs.catalog(spark, str(tmp_path / d)) for d in (".claude", ".codex")]
    got = {r.id: r for r in logs.discover(*both, limit=5).collect()}
    assert set(got) == {"claude:one", "codex:two"} and got["claude:one"].message_count == 2
    name = spark.range(1).select(*[c.alias(n) for c, n in zip(logs.session_log_name(F.lit("/l/2024-01-01T00:00:00_77_claude.jsonl")), ("a", "pid", "label"))]).first()
    assert tuple(name) == ("2024-01-01T00:00:00", 77, "claude")


def test_command_output(spark):
    status = ["## main...origin/main [ahead 2, behind 1]", "M  a", " M b", "MM c", "?? d", "UU e"]
    r = logs.parse_git_status(spark.createDataFrame([("r", x) for x in status], "repo_id string, value string")).first()
    assert (r.staged, r.unstaged, r.untracked, r.conflicts, r.branch, r.ahead, r.behind) == (2, 2, 1, 1, "main", 2, 1)
    lines = ["node 12 me 5u IPv4 0x0 0t0 TCP 127.0.0.1:3000 (LISTEN)", "sshd 1 root 3u IPv4 0 0t0 TCP *:22 (LISTEN)", "COMMAND PID"]
    assert [tuple(x) for x in logs.parse_ports(spark.createDataFrame([(x,) for x in lines], "value string")).collect()] == [("node", 12, "127.0.0.1", 3000)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    manifest = {r.name: r for r in sinks.bundle({"t": rows}, str(tmp_path / "b")).collect()}
    assert manifest["t.jsonl"].rows == 2 and manifest["t.jsonl"].bytes == len('{"id":1,"text":"a"}\n{"id":2,"text":null}\n')
    assert sinks.export_sqlite(rows, str(tmp_path / "x.db"), "t", "id") == 2
    with sqlite3.connect(tmp_path / "x.db") as db:
        assert db.execute("select id, text from t order by id").fetchall() == [(1, "a"), (2, None)]
    m = spark.createDataFrame([("t", 2, "assistant", "B"), ("t", 1, "user", "A")], "transcript_id string, line int, role string, content string")
    assert sinks.markdown(m).first().markdown == "## User\n\nA\n\n## Assistant\n\nB"
    merged = sinks.upsert(rows, spark.createDataFrame([(2, "n"), (3, "z")], "id long, text string"), "id")
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (2, "n"), (3, "z")]
    twice = spark.createDataFrame([(2, "x", 5), (2, "n", 9), (3, "z", 1), (3, "y", 1)], "id long, text string, at int")
    merged = sinks.upsert(rows.withColumn("at", F.lit(0)), twice, "id", "at")
    assert sorted(map(tuple, merged.collect())) == [(1, "a", 0), (2, "n", 9), (3, "z", 1)]


HOOKS = [
    {"event": "start", "session_id": "s", "timestamp": 1_000}, {"event": "pre", "session_id": "s", "tool_use_id": "a", "tool_name": "Bash", "timestamp": 2_000}, {"event": "post", "session_id": "s", "tool_use_id": "a", "timestamp": 2_500},
    {"event": "pre", "session_id": "s", "tool_use_id": "b", "tool_name": "Read", "timestamp": 3_000}, {"event": "post", "session_id": "s", "tool_use_id": "b", "timestamp": 3_100, "error": "x"}, {"event": "tokens", "session_id": "s", "timestamp": 3_200, "input_tokens": 1000, "output_tokens": 500},
    {"event": "tokens", "session_id": "s", "timestamp": 3_300, "input_tokens": 2000, "output_tokens": 800}, {"event": "pre", "session_id": "unknown", "tool_use_id": "c", "timestamp": 4_000}, {"event": "end", "session_id": "s", "timestamp": 9_000},
]


def drain(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.sql(f"select * from {name}").collect()


def test_live_pairs_and_stats(spark, tmp_path):
    put(tmp_path / "in" / "a.json", *HOOKS[:5])
    hooks = live.read_stream(spark, str(tmp_path / "in"))
    got = {r.tool_use_id: (r.duration_ms, r.success) for r in drain(live.paired_calls(hooks), "pairs", "append")}
    assert got == {"a": (500, True), "b": (100, False)}
    done = spark.createDataFrame([("a", "Bash", 500, True), ("b", "Read", 100, False)], "tool_use_id string, tool_name string, duration_ms long, success boolean")
    assert {r.tool_name: r.success_count for r in live.live_tool_stats(done).collect()} == {"Bash": 1, "Read": 0}


def final_sessions(rows):
    last = {}
    for r in rows:
        if r.session_id not in last or last[r.session_id].version < r.version:
            last[r.session_id] = r
    return last


def test_live_sessions(spark, tmp_path):
    put(tmp_path / "in" / "a.json", *HOOKS[:6])
    put(tmp_path / "in" / "b.json", *HOOKS[6:])
    rows = drain(live.live_sessions(live.read_hooks(spark, str(tmp_path / "in"))), "sessions", "update")
    last = final_sessions(rows)
    assert set(last) == {"s"}
    last = last["s"]
    assert (last.status, last.end_time, last.tool_count, last.input_tokens, last.output_tokens) == ("ended", 9_000, 2, 3000, 1300)
    assert [tuple(x) for x in last.tools_used] == []


def test_sessions_keep_arrival_order_over_batches_and_restarts(spark, tmp_path):
    """Equal times in order of arrival; a second run goes on from the checkpoint; the idle timer ends sessions."""
    hour, folder = 3_600_000, tmp_path / "in"
    out = tmp_path / "out"

    def run():
        stream = live.live_sessions(live.read_hooks(spark, str(folder), files_per_trigger=1))
        write = lambda batch, _: batch.write.mode("append").parquet(str(out))
        q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(write).start()
        assert q.awaitTermination(200), "the query did not end by itself"
        return final_sessions(spark.read.parquet(str(out)).collect())

    put(folder / "1.json", {"event": "pre", "session_id": "t", "timestamp": 5}, {"event": "start", "session_id": "t", "timestamp": 5}, {"event": "pre", "session_id": "t", "timestamp": 5}, {"event": "post", "session_id": "t", "tool_name": "Bash", "timestamp": 5}, {"event": "awaiting", "session_id": "t", "timestamp": 5},
        {"event": "auto_continue", "session_id": "t", "timestamp": 5}, {"event": "start", "session_id": "idle", "timestamp": 7}, {"event": "start", "session_id": "done", "timestamp": 7}, {"event": "end", "session_id": "done", "timestamp": 7}, {"event": "pre", "session_id": "done", "timestamp": 9})
    got = run()
    assert (got["t"].tool_count, got["t"].awaiting_user, got["t"].status, got["t"].auto_continue_attempts) == (1, True, "active", 1)
    assert [tuple(x) for x in got["t"].tools_used] == [("Bash", 1)]
    assert (got["done"].status, got["done"].end_time, got["done"].tool_count, got["done"].last_activity) == ("ended", 7, 1, 9)
    put(folder / "2.json", {"event": "pre", "session_id": "t", "timestamp": hour}, {"event": "commit", "session_id": "t", "commit": "abc", "timestamp": hour}, {"event": "auto_continue_reset", "session_id": "t", "timestamp": hour})
    put(folder / "3.json", {"event": "tokens", "session_id": "t", "timestamp": 2 * hour + 10, "input_tokens": 7})
    got = run()
    assert (got["t"].tool_count, got["t"].input_tokens, got["t"].commits, got["t"].auto_continue_attempts) == (2, 7, ["abc"], 0)
    assert (got["idle"].status, got["idle"].end_time) == ("ended", 7)
    put(folder / "4.json", {"event": "pre", "session_id": "done", "timestamp": 3 * hour}, {"event": "start", "session_id": "idle", "timestamp": 3 * hour})
    got = run()
    assert (got["done"].tool_count, got["idle"].status, got["idle"].start_time) == (1, "active", 3 * hour)


def test_windows_and_unique_events(spark, tmp_path):
    e = [{"id": str(i % 3), "timestamp": f"2024-01-01T00:0{i}:00Z", "category": "c"} for i in range(6)]
    put(tmp_path / "in" / "a.json", *e, {"id": "9", "timestamp": "2024-01-01T09:00:00Z", "category": "c"})
    put(tmp_path / "in2" / "a.json", *e)
    got = {(str(r.start), r.n) for r in drain(live.windowed_counts(live.events(spark, str(tmp_path / "in"))), "win", "append")}
    assert {n for _, n in got} == {5, 1}
    assert len(drain(live.unique_events(live.events(spark, str(tmp_path / "in2"))), "uniq", "append")) == 3
    live.to_table(live.events(spark, str(tmp_path / "in2")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_cleanup(spark):
    s = spark.createDataFrame([("gone", 1, "/a", 100, None), ("old", None, "/a", -9_000_000, None), ("idle", None, "/z", -400_000, None), ("ok", 2, "/a", 0, None), ("busy", None, "/a", -400_000, None)], "session_id string, pid long, cwd string, last_activity long, end_time long")
    on = spark.createDataFrame([(2, "/a")], "pid long, cwd string")
    assert {r.session_id for r in live.dead_sessions(s, on, 1_000).collect()} == {"gone", "old", "idle"}
    m = spark.createDataFrame([("a", 7, 0, "running"), ("b", 2, 0, "running"), ("c", None, -4_000_000, "running"), ("d", None, 0, "running"), ("e", 7, 0, "completed")], "id string, pid long, started_at long, status string")
    assert {r.id for r in live.stale_managed(m, on, 0).collect()} == {"a", "c"}
    calls = spark.createDataFrame([("Bash", 0, None), ("Bash", 0, 5), ("Read", 0, None)], "tool_name string, started_at long, completed_at long")
    assert live.long_running(calls, 61_000).count() == 1


def test_files_with_dates_in_their_names(spark, tmp_path):
    for name, n in (("s_2024-01-01.jsonl", 1), ("s_2024-01-05.jsonl", 2), ("s_extra.jsonl", 3), ("t_2024-01-05.jsonl", 4)):
        (tmp_path / name).write_text('{"n": %d}\nbroken\n' % n)
    read = lambda **k: [r.n for r in logs.read_dated(spark, str(tmp_path), "n int", "s_", **k).collect()]
    assert sorted(read()) == [1, 2, 3] and sorted(read(start="2024-01-02")) == [2, 3] and sorted(read(end="2024-01-02")) == [1, 3]
    assert read(limit=1) == [2]
    assert logs.read_dated(spark, str(tmp_path / "none"), "n int").count() == 0


def test_catalogs_of_the_three_layouts(spark, tmp_path):
    claude = tmp_path / "c" / "-home-ann-proj"
    codex = tmp_path / "x" / "sessions" / "2024" / "02" / "03"
    gemini = tmp_path / "g" / "abcdef0123456789" / "chats"
    for d in (claude, codex, gemini):
        d.mkdir(parents=True)
    (claude / "s1.jsonl").write_text('{"type":"user","timestamp":"2024-01-01T00:00:01Z"}\n{"type":"summary","summary":"' + "fix " * 20 + '"}\n{"ts":1704067200}\n')
    (claude / "s2.jsonl").write_text('{"timestamp":"2024-01-01T00:00:03Z"}\n' * 40)
    (codex / "rollout-2024-02-03T04-05-06-x.jsonl").write_text('{"timestamp":"2024-02-03T04:05:06Z"}\n')
    (gemini / "g1.json").write_text('{"lastUpdated":"2024-01-02T00:00:00Z","messages":[{"type":"gemini","timestamp":"2024-01-01T00:00:05Z"},{"type":"user","content":"hello","timestamp":"2024-01-01T00:00:04Z"}]}')
    (gemini / "bad.json").write_text("no json")
    got = {r.id: r for r in logs.discover(logs.claude_catalog(spark, str(tmp_path / "c")), logs.codex_catalog(spark, str(tmp_path / "x")), logs.gemini_catalog(spark, str(tmp_path / "g"))).collect()}
    a = got["claude:s1"]
    assert (a.name, a.project_dir, a.start_time, a.end_time, a.message_count) == (("fix " * 20)[:50], "/home/ann/proj", 1704067200000, 1704067201000, None)
    assert (got["claude:s2"].name, got["claude:s2"].message_count) == ("proj", 2)
    x = got["codex:rollout-2024-02-03T04-05-06-x"]
    assert (x.name, x.project_dir, x.start_time) == ("2024:02:03 04:05:06", "2024-02-03", 1706933106000)
    g = got["gemini:abcdef0123456789:g1"]
    assert (g.name, g.project_dir, g.message_count, g.start_time, g.end_time) == ("hello", "gemini:abcdef012345", 2, 1704067204000, 1704153600000)


def test_ps_and_branches(spark):
    lines = [("  12 1 ?? node 01-02:03:04 5.5 100 7 node  run x",), ("a b",), ("13 x tty1 sh 00:05 - - 0 sh -c",)]
    rows = [tuple(r) for r in logs.parse_ps(spark.createDataFrame(lines, "value string")).collect()]
    assert rows == [(12, 1, None, "node", "node run x", 93784, 5.5, 100, 7), (13, 1, "tty1", "sh", "sh -c", 5, 0.0, None, None)]
    heads = [(1, "## release-1.2"), (2, "## release-1.2...origin/release-1.2 [ahead 3, behind 1]"), (3, "## No commits yet on main")]
    got = {r.repo_id: (r.branch, r.ahead, r.behind) for r in logs.parse_git_status(spark.createDataFrame(heads, "repo_id int, value string")).collect()}
    assert got == {1: ("release-1.2", 0, 0), 2: ("release-1.2", 3, 1), 3: ("main", 0, 0)}


def test_zip_bundle_and_migrations(spark, tmp_path):
    import hashlib
    import json
    import zipfile

    rows = spark.createDataFrame([(i, "é") for i in range(50)], "id int, t string")
    manifest = sinks.zip_bundle({"sessions": rows, "usages": rows.where("id < 3")}, str(tmp_path / "b"), '{"n":1}').collect()
    found = {}
    for r in manifest:
        with zipfile.ZipFile(r.zip.removeprefix("file://")) as z:
            raw = z.read(r.name)
        assert hashlib.sha256(raw).hexdigest() == r.sha256 and len(raw) == r.bytes and raw.count(b"\n") == r.rows
        found.setdefault(r.name.split("-")[0], []).extend(json.loads(x) for x in raw.decode().splitlines())
    assert sorted(x["id"] for x in found["sessions"]) == list(range(50)) and len(found["usages"]) == 3 and found["prep_report"] == [{"n": 1}]
    store = spark.createDataFrame([(1, None, "a"), (2, 1, "b")], "id int, version int, name string")
    up = sinks.migrate(store, {0: lambda df: df.withColumn("name", F.upper("name")), 1: lambda df: df.withColumn("tag", F.concat(F.lit("t"), "name"))})
    assert sorted(tuple(r) for r in up.select("id", "version", "name", "tag").collect()) == [(1, 2, "A", "tA"), (2, 2, "b", "tb")]


CHANGES = "key long, version long, deleted boolean, name string"


def test_change_log(spark, tmp_path):
    log = changelog.ChangeLog(spark, str(tmp_path / "log"), CHANGES)
    rows = lambda *r: spark.createDataFrame(list(r), CHANGES)
    names = lambda **k: {r.key: r.name for r in log.read(**k).collect()}
    assert names() == {}
    log.append(rows((1, 5, False, "a"), (1, 4, False, "old"), (2, 5, None, "b"), (3, 9, True, None)), 0)
    log.append(rows((1, 3, False, "late"), (2, 7, True, None)), 1)
    log.append(rows((1, 3, False, "late"), (2, 7, True, None)), 1)  # replayed
    assert names() == {1: "a"}
    log.compact()
    log.append(rows((2, 6, False, "before the tombstone"), (3, 10, False, "c"), (4, 1, False, "d")), 2)
    assert names() == {1: "a", 3: "c", 4: "d"}
    log.compact(forget=8)
    assert names() == {1: "a", 3: "c", 4: "d"} and names(cap=2) == {3: "c", 1: "a"}
    log.append(rows((2, 6, False, "its tombstone is forgotten"), (4, 0, False, "older")), 3)
    assert names() == {1: "a", 2: "its tombstone is forgotten", 3: "c", 4: "d"}
    assert len(list((tmp_path / "log").glob("base-*"))) == 1


def test_change_log_takes_a_stream(spark, tmp_path):
    put(tmp_path / "in" / "a.json", *[{"key": k % 3, "version": k, "deleted": k == 8, "name": str(k)} for k in range(9)])
    log = changelog.ChangeLog(spark, str(tmp_path / "log"), CHANGES)
    stream = live.read_stream(spark, str(tmp_path / "in"), CHANGES)
    stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(log.append).start().awaitTermination(100)
    assert {r.key: r.name for r in log.read().collect()} == {0: "6", 1: "7"}


def test_ring(spark, tmp_path):
    ring = changelog.Ring(spark, str(tmp_path / "ring"), "id long, name string", [F.col("id").desc()], size=5)
    assert ring.read().count() == 0
    for k, ids in enumerate([range(3), range(3, 20), range(10, 12), [50]]):
        for _ in range(2):  # each batch is replayed
            ring.append(spark.createDataFrame([(i, str(i)) for i in ids], "id long, name string"), k)
    assert [r.id for r in ring.read().collect()] == [50, 19, 18, 17, 16] and [r.id for r in ring.read(2).collect()] == [50, 19]
    assert len(list((tmp_path / "ring").iterdir())) == 2


def test_zip_import_reads_what_the_sink_wrote(spark, tmp_path):
    rows = spark.range(5_000).selectExpr("id", "concat('é', id) as text").repartition(3)
    manifest = sinks.zip_bundle({"t": rows}, str(tmp_path / "b"), report='{"n": 1}')
    lines, status = zips.import_bundle(spark, str(tmp_path / "b"), manifest)
    assert {r.status for r in status.collect()} == {"ok"} and status.count() == manifest.count()
    got = lines.where("name not like 'prep%'").select(F.from_json("value", "id long, text string").alias("j")).select("j.*")
    assert got.exceptAll(rows).count() == 0 and got.count() == 5_000
    assert [r.value for r in lines.where("name like 'prep%'").collect()] == ['{"n": 1}']


def test_damaged_members_are_named(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("good.jsonl", "1\n2\n")
        z.writestr("bad.jsonl", "hello hello hello\n")
        z.writestr("changed.jsonl", "x")
        z.writestr("empty.jsonl", "")
    raw = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "a.zip").write_bytes(raw.replace(b"hello hello hello", b"hello hellO hello"))
    (tmp_path / "cut.zip").write_bytes(raw[:60])
    manifest = spark.createDataFrame([("f/a.zip", n, __import__("hashlib").sha256(x).hexdigest()) for n, x in (("good.jsonl", b"1\n2\n"), ("bad.jsonl", b"hello hello hello\n"), ("changed.jsonl", b"y"), ("gone.jsonl", b""))], "zip string, name string, sha256 string")
    lines, status = zips.import_bundle(spark, str(tmp_path), manifest)
    assert {(r.zip, r.name): r.status for r in status.collect()} == {("a.zip", "good.jsonl"): "ok", ("a.zip", "bad.jsonl"): "damaged", ("a.zip", "changed.jsonl"): "wrong hash", ("a.zip", "empty.jsonl"): "unlisted", ("a.zip", "gone.jsonl"): "missing", ("cut.zip", None): "damaged"}
    assert sorted((r.name, r.line, r.value) for r in lines.collect()) == [("changed.jsonl", 0, "x"), ("good.jsonl", 0, "1"), ("good.jsonl", 1, "2")]


BODIES = [
    ("session-start", '{"session_id":"s","cwd":"/w"}', None), ("session-start", '{"session_id":"s"}', "missing cwd"), ("session-start", '{"session_id":"","cwd":null}', "missing session_id, cwd"), ("session-end", '{"session_id":0}', "missing session_id"),
    ("session-end", '{"session_id":7,"more":{"deep":[1]}}', None), ("pre-tool-use", '{"session_id":"s","tool_name":"Bash"}', None), ("post-tool-use", '{"session_id":"s","tool_name":false}', "missing tool_name"), ("stop", "not json", None), ("stop", None, None), ("pre-compact", "[]", None),
    ("notification", "not json", "body is no JSON object"), ("notification", "[1]", "body is no JSON object"), ("user-prompt-submit", "{}", None), ("unheard-of", "{}", "unknown endpoint"), (None, "{}", "unknown endpoint"), ("session-end", None, "body is no JSON object"),
]


def test_intake_checks_each_endpoint_and_bears_replays(spark, tmp_path):
    rows = spark.createDataFrame([b[:2] for b in BODIES], "endpoint string, body string")
    intake = ingest.Intake(spark, str(tmp_path / "in"))
    intake.append(rows.limit(0), 0)
    for _ in range(2):
        intake.append(rows, 1)
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.endpoint, r.body) for r in intake.good().collect()), key=key) == sorted((b[:2] for b in BODIES if b[2] is None), key=key)
    assert sorted(((r.endpoint, r.body, r.reason) for r in intake.rejected().collect()), key=key) == sorted((b for b in BODIES if b[2] is not None), key=key)
    events = ingest.hook_events(intake.good()).collect()
    assert sorted((r.event, r.session_id) for r in events) == [("end", "7"), ("pre", "s"), ("start", "s")]


def test_legacy_bundle_is_in_one_order(spark, tmp_path):
    sessions = spark.createDataFrame([("b", None), ("a", 1)], "session_id string, n int").repartition(2)
    usages = spark.range(3_000).selectExpr("lpad(cast(id as string), 5, '0') as tool_use_id").repartition(5)
    sinks.legacy_bundle(sessions, usages, str(tmp_path / "b"), "id1", "2024-01-01T00:00:00Z", {"pii": 2, "key": 1})
    lines = [json.loads(x) for f in sorted((tmp_path / "b").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[0] == {"type": "manifest", "bundle_id": "id1", "version": "1.0.0", "exported_at": "2024-01-01T00:00:00Z", "session_count": 2, "tool_usage_count": 3000, "sanitization": {"total_redactions": 3, "categories": {"key": 1, "pii": 2}}}
    assert lines[1:3] == [{"type": "session", "data": {"session_id": "a", "n": 1}}, {"type": "session", "data": {"session_id": "b", "n": None}}]
    assert [x["data"]["tool_use_id"] for x in lines[3:]] == [f"{k:05d}" for k in range(3_000)]
    summary = sinks.markdown(spark.createDataFrame([("t", 1, "user", "A")], "transcript_id string, line int, role string, content string"), spark.createDataFrame([("t", "pii", 2), ("t", "key", 1)], "transcript_id string, category string, n int")).first().markdown
    assert summary.startswith("## User\n\nA\n\n---\n\n## Redaction Summary\n\n**Total redactions:** 3\n\n**By category:**\n- key: 1\n- pii: 2\n\n> **Note:**")


def test_a_batch_of_a_session_takes_few_state_calls():
    """However many events and restarts a batch has: each call of the state store goes to the JVM and back."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    calls = []

    class Recorder:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, method):
            return lambda *args: calls.append(f"{self.name}.{method}") or (None if method == "get" and self.name == "session" else [])

    processor = live.SessionProcessor(10)
    processor.init(SimpleNamespace(getValueState=lambda *_: Recorder("session"), getMapState=lambda *_: Recorder("tools"), getListState=lambda *_: Recorder("commits"), **{m: (lambda *_, m=m: calls.append(m) or []) for m in ("listTimers", "deleteTimer", "registerTimer")}))
    rows = [Row(event=e, timestamp=k, tool_name="Bash", input_tokens=1, output_tokens=None, commit="c", arrival=f"{k:05}") for k in range(200) for e in ("start", "pre", "post", "tokens", "commit")]
    (out,) = processor.handleInputRows(("s",), iter(rows[::-1][::5] + rows), None)
    assert (out.status, out.start_time, out.tool_count, out.commits) == ("active", 199, 1, ["c"])  # a commit before the last start is of the run before
    assert [tuple(x) for x in out.tools_used] == [("Bash", 1)]
    assert len(calls) <= 6
