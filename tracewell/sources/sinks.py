"""Writers: partitioned logs, versioned tables, bundles with checksums, Markdown, SQLite."""

from __future__ import annotations

import sqlite3

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.js import day


def append_log(rows: DataFrame, path: str, timestamp: str = "timestamp", format: str = "json") -> None:
    """Append rows to ``dt=`` partitions by UTC day."""
    rows.withColumn("dt", day(F.col(timestamp))).write.mode("append").partitionBy("dt").format(format).save(path)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of ``new`` over those of ``old`` with the same key; write the result to a new folder.

    Of several rows of ``new`` with one key the last by ``order`` stays (without it, or with equal ones, the greatest
    row), and so of ``old``, so a key stands once.
    """

    def once(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != key]
        first = [order] if order in rest else []
        return rows.groupBy(key).agg(F.max(F.struct(*first, *[c for c in rest if c not in first])).alias("_row")).select(key, "_row.*").select(rows.columns) if rest else rows.distinct()

    return once(old.join(new.select(key), key, "left_anti")).unionByName(once(new), allowMissingColumns=True)


def migrate(store: DataFrame, migrations: dict[int, object], version: str = "version") -> DataFrame:
    """A store in its latest version: rows of version k pass through ``migrations[k]``, ``[k + 1]``, ... in turn.

    A migration takes and gives a DataFrame; rows without a version count as version 0.
    """
    latest = max(migrations, default=-1) + 1
    out = store.withColumn(version, F.coalesce(F.col(version), F.lit(0)).cast("int"))
    for k in range(latest):
        if k in migrations:
            old = migrations[k](out.where(F.col(version) == k)).withColumn(version, F.lit(k + 1))
            out = out.where(F.col(version) != k).unionByName(old, allowMissingColumns=True)
    return out


def zip_bundle(tables: dict[str, DataFrame], folder: str, report: str = "{}") -> DataFrame:
    """Tables as JSON lines in ZIP files: each task writes one, with a member for each table part it holds.

    A row for each member: zip, name, rows, bytes, sha256 (of the member's bytes); committed rows name the files that count.
    """
    import hashlib
    import uuid
    import zipfile

    import pyarrow as pa
    from pyarrow import fs

    def run(batches):
        members: dict[str, list] = {}
        state: dict = {"n": 0}

        def flush(name):
            if "zip" not in state:
                uri = f"{folder}/{uuid.uuid4().hex}.zip"
                where, path = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)
                where.create_dir(path.rsplit("/", 1)[0], recursive=True)
                state["uri"], state["out"] = uri, where.open_output_stream(path, compression=None)
                state["zip"] = zipfile.ZipFile(state["out"], "w", zipfile.ZIP_DEFLATED)
            lines = members.pop(name)
            raw = "".join(x + "\n" for x in lines).encode()
            member = f"{name}-{state['n']:05d}.jsonl"
            state["n"] += 1
            state["zip"].writestr(zipfile.ZipInfo(member), raw, zipfile.ZIP_DEFLATED)
            return pa.RecordBatch.from_arrays([pa.array([state["uri"]]), pa.array([member]), pa.array([len(lines)], pa.int64()), pa.array([len(raw)], pa.int64()), pa.array([hashlib.sha256(raw).hexdigest()])], names=["zip", "name", "rows", "bytes", "sha256"])

        for batch in batches:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist()):
                members.setdefault(name, []).append(value)
                if len(members[name]) >= 2_000:
                    yield flush(name)
        for name in list(members):
            yield flush(name)
        if "zip" in state:
            state["zip"].close()
            state["out"].close()

    rows = None
    for name, table in tables.items():
        lines = json_lines(table).select(F.lit(name).alias("name"), "value")
        rows = lines if rows is None else rows.unionByName(lines)
    spark = rows.sparkSession
    rows = rows.unionByName(spark.createDataFrame([("prep_report", report)], "name string, value string"))
    rows.mapInArrow(run, "zip string, name string, rows long, bytes long, sha256 string").write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON text per row, nulls kept."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as JSON lines under ``path``, then the manifest: name, rows, bytes, and sha256 over the rows' own digests in order."""
    spark = next(iter(tables.values())).sparkSession
    out = None
    for name, rows in tables.items():
        json_lines(rows).write.mode("overwrite").text(f"{path}/{name}.jsonl")
        lines = spark.read.text(f"{path}/{name}.jsonl")
        # a digest that does not depend on the order of files: the sum of the rows' digests' leading bits, hashed
        one = lines.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes"), F.sha2(F.coalesce(F.sum(F.conv(F.substring(F.sha2("value", 256), 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string"), 256).alias("sha256"))
        one = one.select(F.lit(f"{name}.jsonl").alias("name"), "rows", "bytes", "sha256")
        out = one if out is None else out.unionByName(one)
    json_lines(out).coalesce(1).write.mode("overwrite").text(f"{path}/manifest.json")  # a row per table
    return out


def legacy_bundle(sessions: DataFrame, usages: DataFrame, path: str, bundle_id: str, exported_at: str, redactions: dict[str, int] | None = None, order: tuple[str, str] = ("session_id", "tool_use_id")) -> None:
    """One list of unlike lines over many part files: the manifest, then sessions and tool usages, each in its order.

    Lines are dealt by ranges of (kind, order), so the part files, read by name one after the other, are in order, and
    no task holds more than its range. ``redactions``: their number by category.
    """
    counted = sessions.agg(F.count("*").alias("session_count")).crossJoin(F.broadcast(usages.agg(F.count("*").alias("tool_usage_count"))))  # one row each
    by = redactions or {}
    categories = F.create_map(*[F.lit(x) for pair in sorted(by.items()) for x in pair]) if by else F.from_json(F.lit("{}"), "map<string,int>")
    report = F.struct(F.lit(sum(by.values())).alias("total_redactions"), categories.alias("categories"))
    head = counted.select(F.lit(0).alias("kind"), F.lit("").alias("at"), F.to_json(F.struct(F.lit("manifest").alias("type"), F.lit(bundle_id).alias("bundle_id"), F.lit("1.0.0").alias("version"), F.lit(exported_at).alias("exported_at"), "session_count", "tool_usage_count", report.alias("sanitization"))).alias("value"))
    line = lambda rows, k, kind, key: rows.select(F.lit(k).alias("kind"), F.col(key).cast("string").alias("at"), F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*rows.columns).alias("data")), {"ignoreNullFields": "false"}).alias("value"))
    lines = head.unionByName(line(sessions, 1, "session", order[0])).unionByName(line(usages, 2, "tool_usage", order[1]))
    lines.orderBy("kind", "at", "value").select("value").write.mode("overwrite").text(path)


# Fixed value: the note under a sanitized transcript.
SANITIZED_NOTE = "> **Note:** This transcript has been automatically sanitized. Please review manually before sharing to ensure no sensitive information remains."


def markdown(messages: DataFrame, redactions: DataFrame | None = None) -> DataFrame:
    """transcript_id, markdown: role headers and contents in order of line.

    With ``redactions`` (transcript_id, category, n) a summary follows: their number, and that of each category by name.
    """
    block = F.concat(F.lit("## "), F.initcap("role"), F.lit("\n\n"), F.coalesce("content", F.lit("")))
    per = messages.groupBy("transcript_id").agg(F.array_sort(F.collect_list(F.struct("line", block.alias("text")))).alias("blocks"))
    body = F.array_join(F.transform("blocks", lambda b: b.text), "\n\n")
    if redactions is None:
        return per.select("transcript_id", body.alias("markdown"))
    by = redactions.groupBy("transcript_id", "category").agg(F.sum("n").alias("n")).groupBy("transcript_id").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("category", "n"))).alias("by"))
    each = F.concat(F.lit("**By category:**\n"), F.array_join(F.transform("by", lambda c: F.concat(F.lit("- "), c.category, F.lit(": "), c.n.cast("string"))), "\n"), F.lit("\n\n"))
    summary = F.concat(F.lit("## Redaction Summary\n\n**Total redactions:** "), F.coalesce("total", F.lit(0)).cast("string"), F.lit("\n\n"), F.coalesce(each, F.lit("")), F.lit(SANITIZED_NOTE + "\n"))
    return per.join(by, "transcript_id", "left").select("transcript_id", F.concat(body, F.lit("\n\n---\n\n"), summary).alias("markdown"))


def display_line(role: Column, tool: Column, content: Column) -> Column:
    """A line of a listing: tool calls are marked, blank contents give null."""
    return F.when(F.trim(content) == "", None).when(tool.isNotNull(), F.concat(F.lit("["), tool, F.lit("] "), content)).otherwise(F.concat(F.coalesce(role, F.lit("unknown")), F.lit(": "), content))


def export_sqlite(rows: DataFrame, path: str, table: str, key: str, most: int = 1_000_000) -> int:
    """Rows of a small result into a local SQLite file on the driver; returns their number. Over ``most`` rows raise."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows: write Parquet instead")
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "boolean": "INTEGER", "double": "REAL"}
    columns = ", ".join(f'"{c}" {kinds.get(t, "TEXT")}' + (" PRIMARY KEY" if c == key else "") for c, t in rows.dtypes)
    n = 0
    with sqlite3.connect(path) as db:
        db.execute(f'DROP TABLE IF EXISTS "{table}"')
        db.execute(f'CREATE TABLE "{table}" ({columns})')
        for row in rows.toLocalIterator():
            db.execute(f'INSERT OR REPLACE INTO "{table}" VALUES ({", ".join("?" * len(rows.columns))})', tuple(row))
            n += 1
    return n
