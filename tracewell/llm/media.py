"""Media columns: content-addressed payloads in tar shards; rows carry digest, shard, offset and length.

A payload (bytes, padded with 0 to a positive multiple of 64) is stored as an 8-bit grey PNG of width 64, which is
lossless and compressed, once in the whole corpus, under its SHA-256 in a tar shard of the shared folder. Digests are
counted first. Payloads that stand once go to shards from the task that reads them, without a shuffle; of those that
stand more often, which a bitmap of bounded size picks out, one copy each is dealt out and stored.

``fill_metadata`` reads only the first 33 bytes of each file by a range read; ``read_features`` reads the stored bytes
back and decodes them. Both work on payloads; rows, however many share one, get the values by a join on the digest.

Null text is an empty payload (64 zero bytes); repeated rows share a stored file; an empty table gives no shard. A text
of any length is one payload, held by its task. Which copy of equal texts is stored makes no difference to any value.
Columns of other names are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import arrow_pass, batch_of, bitmap, has, materialize, release, shared_dir, texts

WIDTH = 64
SHARD_BYTES = 32_000_000
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: signature and IHDR chunk
HEADER_BYTES = 33


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A grey 8-bit PNG of width 64; the payload's length is a positive multiple of 64."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from the first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def from_png(media: bytes) -> np.ndarray:
    """Samples of a grey 8-bit PNG whose rows use filter 0, as ``to_png`` writes them; checks each chunk's CRC."""
    width, height, _ = png_header(media)
    at, data = 8, []
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk of the PNG is damaged")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("only rows without a filter are read")
    return rows[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Shape, mean, deviation, entropy in bits and shares (per mille) of 8 bands of the samples."""
    counts = np.bincount(samples.ravel(), minlength=256)
    share = counts / samples.size
    levels = np.arange(256)
    mean = float(share @ levels)
    deviation = float(np.sqrt(max(0.0, share @ (levels - mean) ** 2)))
    entropy = float(-(share[share > 0] @ np.log2(share[share > 0])))
    bands = np.floor(counts.reshape(8, 32).sum(axis=1) * 1000 / samples.size).astype(int)
    return f"{samples.shape[1]}x{samples.shape[0]} mean={mean:.3f} dev={deviation:.3f} bits={entropy:.3f} bands={'/'.join(map(str, bands))}"


def payload_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_bytes, digest (SHA-256 of the padded payload), h (a hash of the digest)."""
    raw = F.col("text").cast("binary")
    n = F.octet_length("text")
    pad = F.when(n == 0, 64).otherwise(F.pmod(-n, F.lit(64)))
    keyed = texts(docs).select("doc_id", "text", n.cast("long").alias("n_bytes"), F.unhex(F.sha2(F.concat(raw, F.unhex(F.repeat(F.lit("00"), pad))), 256)).alias("digest"))
    return keyed.withColumn("h", F.xxhash64("digest"))


_STORED = "digest binary, shard string, offset long, length long"


def _store(folder: str):
    """A pass over (text, digest) that stores each row's payload."""

    def run(batches):
        shard, at, done = [], 0, []

        def close():
            uri = files.write_new(folder, ".tar", b"".join(shard) + bytes(1024))
            digest, offset, length = zip(*done)
            return batch_of(digest=pa.array(digest, pa.binary()), shard=pa.array([uri] * len(done)), offset=pa.array(offset, pa.int64()), length=pa.array(length, pa.int64()))

        for batch in batches:
            for k in range(len(batch)):
                raw = batch.column("text")[k].as_py().encode()
                payload = raw + bytes(-len(raw) % 64 if raw else 64)
                digest = hashlib.sha256(payload).digest()
                if digest != batch.column("digest")[k].as_py():
                    raise ValueError("a payload differs from its digest")
                media = to_png(payload)
                member = tarfile.TarInfo(f"{digest.hex()}.png")
                member.size = len(media)
                head = member.tobuf(tarfile.USTAR_FORMAT)
                done.append((digest, at + len(head), len(media)))
                shard += [head, media, bytes(-len(media) % 512)]
                at += len(head) + len(media) + len(shard[-1])
                if at >= SHARD_BYTES:
                    yield close()
                    shard, at, done = [], 0, []
        if done:
            yield close()

    return run


def store_media(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store each distinct payload as media; a row for each: digest, shard, offset, length. A written table."""
    folder = folder or shared_dir(docs.sparkSession, "media")
    keyed = payload_keys(docs)
    repeated = materialize(keyed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "media-repeated")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(repeated))
    release(repeated)

    def single(batches):
        for batch in batches:
            yield batch.filter(pa.array(~has(shared.value, batch.column("h").to_numpy())))

    def several(batches):
        seen: set = set()  # copies of a task go on once
        for batch in batches:
            h = batch.column("h").to_numpy()
            if len(seen) > 1_000_000:
                seen.clear()
            new = {h[i]: i for i in np.flatnonzero(has(shared.value, h)).tolist() if h[i] not in seen}
            seen.update(new)
            yield batch.take(pa.array(sorted(new.values()), pa.int64()))

    rows = keyed.select("text", "digest", "h")
    once = rows.mapInArrow(lambda batches: _store(folder)(single(batches)), _STORED)
    copies = arrow_pass(rows, several, "text string, digest binary, h long").dropDuplicates(["digest"])
    return materialize(once.unionByName(arrow_pass(copies.select("text", "digest"), _store(folder), _STORED)), "media-files")


def _by_shard(batches, read):
    """Rows come sorted by shard; ``read(reader, offset, length)`` gives a tuple per row."""
    uri, reader = None, None
    for batch in batches:
        out = []
        for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length"))):
            if shard != uri:
                if reader:
                    reader.close()
                uri, reader = shard, files.RangeReader(shard)
            out.append(read(reader, offset, length))
        if out:
            yield batch, [list(x) for x in zip(*out)]
    if reader:
        reader.close()


def fill_metadata(stored: DataFrame) -> DataFrame:
    """Add width, height and bit_depth from each file's header alone."""
    kept = ["digest", "shard", "offset", "length"]

    def run(batches):
        for batch, (width, height, depth) in _by_shard(batches, lambda f, offset, length: png_header(f.read(offset, HEADER_BYTES))):
            yield batch_of(**{c: batch.column(c) for c in kept}, width=pa.array(width, pa.int64()), height=pa.array(height, pa.int64()), bit_depth=pa.array(depth, pa.int64()))

    n = max(1, min(stored.select("shard").distinct().count(), 10_000))
    dealt = stored.select(kept).repartition(n, "shard").sortWithinPartitions("shard", "offset")
    return arrow_pass(dealt, run, _STORED + ", width long, height long, bit_depth long")


def read_features(stored: DataFrame) -> DataFrame:
    """Read each stored file back and add payload and media digests and a feature."""
    kept = ["digest", "width", "height", "bit_depth"]

    def read(f, offset, length):
        media = f.read(offset, length)
        samples = from_png(media)
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).digest(), feature(samples)

    def run(batches):
        for batch, (size, sha, tail, media_bytes, media_sha, features) in _by_shard(batches, read):
            if sha != batch.column("digest").to_pylist():
                raise ValueError("a stored payload differs from its digest")
            yield batch_of(
                **{c: batch.column(c) for c in kept}, payload_bytes=pa.array(size, pa.int64()), tail_crc32=pa.array(tail, pa.int64()),
                media_bytes=pa.array(media_bytes, pa.int64()), media_sha256=pa.array(media_sha, pa.binary()), feature=pa.array(features),
            )

    return arrow_pass(stored, run, "digest binary, width long, height long, bit_depth long, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 binary, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height, bit_depth."""
    media = read_features(fill_metadata(store_media(docs)))  # which has found the digest of what it read to be this one
    rows = payload_keys(docs).select("doc_id", "n_bytes", "digest").join(media, "digest")
    shown = lambda c, name: F.lower(F.hex(c)).alias(name)
    return rows.select("doc_id", "n_bytes", "payload_bytes", shown("digest", "payload_sha256"), "tail_crc32", "media_bytes", shown("media_sha256", "media_sha256"), "feature", "width", "height", "bit_depth")
