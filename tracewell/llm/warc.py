"""WARC archives: records written as gzip members by the tasks, read back in pieces, reassembled from segments.

Writing: a record per page. Its block is an HTTP response in chunked transfer framing; a block over ``segment_bytes``
becomes a first record and continuation records (WARC-Segment-Number, WARC-Segment-Origin-ID, and
WARC-Segment-Total-Length on the last). Of records with equal payloads of ``revisit_bytes`` or more, that with the
largest page id is a response, the others are revisit records that name it (WARC-Refers-To) and carry no payload. Each
record is a gzip member of its own; a file is closed at ``FILE_BYTES``. A manifest beside the files lists those of
committed tasks, so a task that runs twice does no harm.

Reading: files are decompressed and parsed in pieces, member by member; continuations are grouped by origin
identifier, ordered by segment number, their total length is verified, and chunked framing is decoded. A wrong
length, a gap or a wrong digest raises.

Null html is an empty payload. Null or repeated page ids are records of their own: each row has its own record id.
Rows that share both page id and payload are all responses if theirs is the largest id. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import arrow_pass, batch_of, join_small, materialize, release, shared_dir

SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
REVISIT_BYTES = 1_000
#: compressed bytes at which an archive file is closed
FILE_BYTES = 256_000_000
#: bytes of a file that are read at once, and of records that are handed on at once
PIECE_BYTES = 4_000_000
_CRLF = "\r\n"


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_CRLF)), F.lit(""))


def _chunked(payload: Column) -> Column:
    """Chunked transfer framing of a binary column, as a string of the same bytes."""
    starts = F.sequence(F.lit(0), F.floor((F.octet_length(payload) - 1) / CHUNK_BYTES).cast("int"))
    piece = lambda i: F.substring(payload, i * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES))
    framed = F.transform(starts, lambda i: F.concat(F.lower(F.hex(F.octet_length(piece(i)).cast("long"))), F.lit(_CRLF), piece(i).cast("string"), F.lit(_CRLF)))
    return F.concat(F.when(F.octet_length(payload) > 0, F.array_join(framed, "")).otherwise(""), F.lit("0" + _CRLF * 2))


def mark_revisits(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest (SHA-1, hex), rid (record id), refers_to (null for responses),
    refers_rid (null also where the row referred to stands several times).

    A record id is a hash of page id, address and payload; rows that are equal in all three are told apart by number."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    named = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce("url", F.lit("-")), "digest"))
    as_uuid = lambda h: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    rows = rows.withColumn("rid", as_uuid(named))
    keys = materialize(rows.select("page_id", "payload_bytes", "digest", "rid"), "page-keys")
    groups = keys.where(F.col("payload_bytes") >= revisit_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "rid")).alias("largest"), F.count("*").alias("rows"))
    repeated = materialize(groups.where("rows > 1 and largest.page_id is not null").select("digest", F.col("largest.page_id").alias("largest"), F.col("largest.rid").alias("largest_rid")), "revisits")
    equal = materialize(keys.groupBy("rid").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("rid").alias("same_rid")), "equal-pages")
    repeated = materialize(join_small(repeated, equal, F.col("largest_rid") == F.col("same_rid"), "left").select("digest", "largest", F.when(F.col("same_rid").isNull(), F.col("largest_rid")).alias("largest_rid")), "revisits")
    release(keys)
    joined = join_small(join_small(rows, repeated, "digest", "left"), equal, F.col("rid") == F.col("same_rid"), "left")
    numbered = as_uuid(F.md5(F.concat_ws("|", "rid", F.monotonically_increasing_id().cast("string"))))
    joined = joined.withColumn("rid", F.when(F.col("same_rid").isNull(), F.col("rid")).otherwise(numbered))
    other = ~F.col("page_id").eqNullSafe(F.col("largest"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "digest", "rid", F.when(other, F.col("largest")).alias("refers_to"), F.when(other, F.col("largest_rid")).alias("refers_rid"))


def write_archives(pages: DataFrame, folder: str | None = None, segment_bytes: int = SEGMENT_BYTES, revisit_bytes: int = REVISIT_BYTES, captured: Column | None = None) -> str:
    """Write archive files and their manifest, and return the folder. ``captured``: the time of capture, now if not given."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    rows = mark_revisits(pages, revisit_bytes)
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Transfer-Encoding: chunked{_CRLF}{_CRLF}"), _chunked(F.col("payload")))
    rows = rows.withColumn("block", F.when(revisit, F.lit(f"HTTP/1.1 304 Not Modified{_CRLF}{_CRLF}")).otherwise(http).cast("binary"))
    rows = rows.withColumn("segments", F.greatest(F.lit(1), F.ceil(F.octet_length("block") / segment_bytes)).cast("int"))
    rows = rows.withColumn("number", F.explode(F.sequence(F.lit(1), F.col("segments"))))
    part = F.substring(F.col("block"), (F.col("number") - 1) * segment_bytes + 1, F.lit(segment_bytes))
    several, first = F.col("segments") > 1, F.col("number") == 1
    record = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        _header("WARC-Type", F.when(revisit, "revisit").when(first, "response").otherwise("continuation")),
        _header("WARC-Record-ID", F.when(first, F.col("rid")).otherwise(F.concat(F.regexp_replace("rid", ">$", "-"), F.col("number").cast("string"), F.lit(">")))),
        _header("WARC-Date", F.date_format(F.to_utc_timestamp(captured if captured is not None else F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _header("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "%20")),
        _header("WARC-Page-ID", F.col("page_id")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Payload-Length", F.col("payload_bytes")),
        _header("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _header("WARC-Refers-To", F.col("refers_rid")),
        _header("WARC-Refers-To-Page-ID", F.col("refers_to")),
        _header("WARC-Segment-Number", F.when(several, F.col("number"))),
        _header("WARC-Segment-Origin-ID", F.when(~first, F.col("rid"))),
        _header("WARC-Segment-Total-Length", F.when(several & (F.col("number") == F.col("segments")), F.octet_length("block"))),
        F.lit(f"Content-Type: application/http; msgtype=response{_CRLF}"),
        _header("Content-Length", F.octet_length(part)),
        F.lit(_CRLF),
        part.cast("string"),
    )
    several_rows = rows.select(F.concat(record.cast("binary"), F.lit(_CRLF * 2).cast("binary")).alias("record"))
    several_rows.mapInArrow(_write_files(f"{folder}/data"), "path string, records long, bytes long").write.parquet(f"{folder}/manifest")
    return folder


def _write_files(folder: str):
    """A pass over (record) that appends each as a gzip member to the task's open file."""

    def run(batches):
        path, out, records = None, None, 0

        def close():
            size = out.tell()
            out.close()
            return batch_of(path=pa.array([path]), records=pa.array([records], pa.int64()), bytes=pa.array([size], pa.int64()))

        for batch in batches:
            for record in batch.column("record"):
                if out is None:
                    path, out = files.open_new(folder, ".warc.gz")
                    records = 0
                member = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(member.compress(record.as_py()) + member.flush())
                records += 1
                if out.tell() >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def members(uri: str):
    """The gzip members of a file, read in pieces; no more than a member and a piece are held."""
    with files.open_read(uri) as f:
        unzip, held = zlib.decompressobj(31), []
        while piece := f.read(PIECE_BYTES):
            while piece:
                held.append(unzip.decompress(piece))
                piece = unzip.unused_data if unzip.eof else b""
                if unzip.eof:
                    yield b"".join(held)
                    unzip, held = zlib.decompressobj(31), []
        if any(held):
            raise ValueError(f"{uri} ends inside a record")


def parse_records(raw: bytes):
    """(headers by lower-case name, block) of each record of an archive file."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:end].decode("utf-8").split(_CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        start = end + 4
        if raw[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has a wrong length")
        yield head, raw[start : start + size]
        at = start + size + 4


def decode_http(block: bytes) -> bytes:
    """The payload of an HTTP response, out of chunked framing if its header says so."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    at, out = 0, []
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk framing")
        at = end + 4 + size


_RECORD = "record_id string, record_type string, page_id long, digest string, payload_bytes long, refers_to long, number int, total long, block binary"
_OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record; continuation records carry the origin's identifier as record_id."""

    def number(head: dict, name: str):
        return int(head[name]) if name in head else None

    def run(batches):
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
        rows = lambda out: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                out, held = [], 0
                for head, block in (record for member in members(path) for record in parse_records(member)):
                    out.append((head.get("warc-segment-origin-id", head["warc-record-id"]), head["warc-type"], number(head, "warc-page-id"), head.get("warc-payload-digest", "").removeprefix("sha1:"), number(head, "warc-payload-length"), number(head, "warc-refers-to-page-id"), number(head, "warc-segment-number"), number(head, "warc-segment-total-length"), block))
                    held += len(block)
                    if held > PIECE_BYTES:
                        yield rows(out)
                        out, held = [], 0
                if out:
                    yield rows(out)

    manifest = spark.read.parquet(f"{folder}/manifest")
    return arrow_pass(manifest.select("path").repartition(max(1, min(manifest.count(), 10_000))), run, _RECORD)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: the segments of a record joined in order; a gap or a wrong total length raises."""
    one = records.where("number is null")
    parts = records.where("number is not null").groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"),
        F.max(F.when(F.col("number") == 1, F.struct("record_type", "page_id", "digest", "payload_bytes", "refers_to"))).alias("first"),
    )
    joined = parts.withColumn("block", F.array_join(F.transform("parts", lambda p: p.block.cast("string")), "").cast("binary"))
    last = F.element_at("parts", -1).number
    wrong = F.coalesce(F.octet_length("block") != F.col("total"), F.lit(True)) | (last != F.size("parts"))
    joined = joined.withColumn("block", F.when(wrong, F.raise_error(F.concat(F.lit("segments missing of "), F.col("record_id"))).cast("binary")).otherwise(F.col("block")))
    columns = ["record_id", "record_type", "page_id", "digest", "payload_bytes", "refers_to", "block"]
    return one.select(columns).unionByName(joined.select("record_id", "first.*", "block").select(columns))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits), verified."""

    def run(batches):
        for batch in batches:
            size, digest, payloads = [], [], []
            for kind, said, length, block in zip(*(batch.column(c).to_pylist() for c in ("record_type", "digest", "payload_bytes", "block"))):
                payload = None if kind == "revisit" else decode_http(block)
                if payload is not None and (len(payload) != length or hashlib.sha1(payload).hexdigest() != said):
                    raise ValueError("a payload differs from its record's digest or length")
                payloads.append(payload)
                size.append(length)
                digest.append(said)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(size, pa.int64()), pa.array(digest), batch.column("record_type"), batch.column("refers_to"), pa.array(payloads, pa.binary())], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return arrow_pass(reassemble(read_records(spark, folder)), run, _OUT)
