"""Reading ZIP bundles: members are listed from the central directories, and read in runs by range reads.

A task opens a file through pyarrow's file systems (file, hdfs, s3), so only its directory and the members that it is
to read cross the network. A member is read in a stream; its lines, its hash and any fault come out of one pass.
"""

from __future__ import annotations

import hashlib
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: packed bytes that a task reads of one file
RUN_BYTES = 64_000_000
#: lines that are handed on at once
LINES = 5_000


def _opened(uri: str) -> zipfile.ZipFile:
    where, path = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    return zipfile.ZipFile(where.open_input_file(path))


def zip_members(spark: SparkSession, folder: str, pattern: str = "*.zip") -> DataFrame:
    """(zip, name, bytes, at, error): the members of all ZIP files below ``folder``, and files whose directory is broken."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path")

    def run(batches):
        for batch in batches:
            rows = []
            for uri in batch.column("path").to_pylist():
                try:
                    with _opened(uri) as z:
                        rows += [(uri, x.filename, x.file_size, x.header_offset, None) for x in z.infolist() if not x.is_dir()]
                except (zipfile.BadZipFile, OSError, EOFError, ValueError) as e:
                    rows.append((uri, None, None, None, str(e)[:200]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["zip", "name", "bytes", "at", "error"])

    return found.mapInArrow(run, "zip string, name string, bytes long, at long, error string")


def read_members(members: DataFrame) -> DataFrame:
    """(zip, name, line, value, sha256, error): the lines of each member, then a row with its number of lines, its hash
    and what is wrong with it. Bytes that are no UTF-8 are replaced; the hash is of the bytes."""
    schema = "zip string, name string, line long, value string, sha256 string, error string"

    def run(batches):
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["zip", "name", "line", "value", "sha256", "error"])
        opened: tuple[str, zipfile.ZipFile] | None = None
        rows = []
        for batch in batches:
            for uri, name in zip(batch.column("zip").to_pylist(), batch.column("name").to_pylist()):
                digest, n, fault = hashlib.sha256(), 0, None
                try:
                    if opened is None or opened[0] != uri:
                        opened = (uri, _opened(uri))
                    with opened[1].open(name) as f:
                        for raw in f:
                            digest.update(raw)
                            rows.append((uri, name, n, raw.decode("utf-8", "replace").removesuffix("\n"), None, None))
                            n += 1
                            if len(rows) >= LINES:
                                yield flush(rows)
                                rows = []
                except (zipfile.BadZipFile, zlib.error, EOFError, OSError, KeyError, NotImplementedError, RuntimeError) as e:
                    fault = f"{type(e).__name__}: {e}"[:200]
                rows.append((uri, name, n, None, digest.hexdigest() if fault is None else None, fault))
        if rows:
            yield flush(rows)

    whole = members.where("name is not null").withColumn("run", F.floor(F.col("at") / RUN_BYTES))
    return whole.repartition("zip", "run").sortWithinPartitions("zip", "at").select("zip", "name").mapInArrow(run, schema)


def import_bundle(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, status) of the ZIP files below ``folder``, read once.

    lines (zip, name, line, value) are those of whole members. status (zip, name, rows, sha256, status, error): ok,
    damaged (also a file without a readable directory, whose name is null), and by the manifest (zip, name, sha256)
    ``wrong hash``, ``missing`` or, of members it lacks, ``unlisted``. Files are told by their names without folders.
    """
    base = lambda c: F.regexp_extract(c, "[^/]*$", 0)
    members = written(zip_members(spark, folder), "zip-members")
    read = written(read_members(members).withColumn("zip", base("zip")), "zip-lines")
    ends = read.where("value is null").select("zip", "name", F.col("line").alias("rows"), "sha256", "error")
    broken = members.where("name is null").select(base("zip").alias("zip"), "name", F.lit(None).cast("long").alias("rows"), F.lit(None).cast("string").alias("sha256"), "error")
    ends = ends.unionByName(broken)
    if manifest is None:
        status = ends.withColumn("status", F.when(F.col("error").isNotNull(), "damaged").otherwise("ok"))
    else:
        said = manifest.select(base("zip").alias("m_zip"), F.col("name").alias("m_name"), F.col("sha256").alias("m_sha256"))
        both = ends.join(said, (F.col("zip") == F.col("m_zip")) & (F.col("name") == F.col("m_name")), "full")
        how = F.when(F.col("zip").isNull(), "missing").when(F.col("error").isNotNull(), "damaged").when(F.col("m_name").isNull(), "unlisted").when(F.col("sha256") != F.col("m_sha256"), "wrong hash").otherwise("ok")
        status = both.select(F.coalesce("zip", "m_zip").alias("zip"), F.coalesce("name", "m_name").alias("name"), "rows", "sha256", how.alias("status"), "error")
    whole = ends.where("error is null").select("zip", "name")
    return read.where("value is not null").select("zip", "name", "line", "value").join(whole, ["zip", "name"], "left_semi"), status
