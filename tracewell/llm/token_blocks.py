"""Token-id output: patched frame-of-reference (PFOR) blocks in shard files, in ascending document order.

A shard file holds whole documents::

    "PFB2"
    body: per block of 128 ids: minimum u32 | width u8 | n_exceptions u8 | n_ids u16
          | packed low bits, 16 x width bytes | positions u8 x n_exceptions | differences u32 x n_exceptions
    doc_id i64 x n_docs | whether a document has an id, a bit each | ids per document u64 x n_docs
    start of each block in the body, u64 x (n_blocks + 1)
    n_ids u64 | n_blocks u32 | n_docs u32 | "PFB2"

Each block subtracts its minimum, packs the differences at the width that holds ``PERCENTILE`` of them, and lists the
wider ones as exceptions. The block index lets a reader open one document without decoding the rest; as it stands at
the end, a writer keeps only the index and one run of blocks in memory.

Texts are dealt by ranges of (doc_id, hash of the text, row number), so that shards follow each other in id order and
one id, or none, may hold any share of the rows; each task then encodes and writes at once. (To encode first and
shuffle ids took more: ids are as large as these texts, and had to be written before ranges could be drawn.) Null texts
are empty documents (end id only), null ids come first, repeated rows are documents of their own, rows of one id come
in the order of a hash of their texts; an empty table gives no shard. A text of any length is encoded by one task, and
its blocks are written as they come. Columns of other names are not read.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files
from .common import arrow_pass, batch_of, materialize, shared_dir, texts
from .tokens import encoder, sliced

BLOCK = 128
PERCENTILE = 0.9
SHARD_IDS = 4_000_000
#: ids that are packed or unpacked at once
RUN = 2048 * BLOCK
_MAGIC = b"PFB2"
_TAIL = np.dtype([("ids", "<u8"), ("blocks", "<u4"), ("docs", "<u4"), ("magic", "S4")])
_BLOCK = np.dtype([("minimum", "<u4"), ("width", "u1"), ("exceptions", "u1"), ("ids", "<u2")])


def _bits(x: np.ndarray) -> np.ndarray:
    """Number of bits of each value below 2**32."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of uint32 ids: the start of each in the body, and the body as bytes."""
    n = -(-len(ids) // BLOCK)
    held = np.full(n, BLOCK, np.int64)
    if n:
        held[-1] = len(ids) - (n - 1) * BLOCK
    padded = np.concatenate([ids, np.full(n * BLOCK - len(ids), ids[-1] if len(ids) else 0, np.uint32)]).reshape(n, BLOCK)
    low = padded.min(axis=1) if n else np.zeros(0, np.uint32)
    diff = padded - low[:, None]
    bits = _bits(diff)
    at = int(np.ceil(PERCENTILE * BLOCK)) - 1
    width = np.partition(bits, at, axis=1)[:, at] if n else np.zeros(0, np.int64)
    over = bits > width[:, None]
    n_over = over.sum(axis=1)
    starts = np.concatenate([[0], np.cumsum(_BLOCK.itemsize + 16 * width + 5 * n_over)]).astype(np.int64)
    body = np.zeros(starts[-1], np.uint8)
    head = np.zeros(n, _BLOCK)
    head["minimum"], head["width"], head["exceptions"], head["ids"] = low, width, n_over, held
    body[starts[:-1, None] + np.arange(_BLOCK.itemsize)] = head.view(np.uint8).reshape(n, _BLOCK.itemsize)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        values = (diff[rows] & np.uint32((1 << int(w)) - 1)).T.astype(np.uint64)
        words = np.zeros((2 * w, len(rows)), np.uint64)
        for j in range(BLOCK):
            q, r = divmod(j * int(w), 64)
            words[q] |= values[j] << np.uint64(r)
            if r + w > 64:
                words[q + 1] |= values[j] >> np.uint64(64 - r)
        body[(starts[rows] + _BLOCK.itemsize)[:, None] + np.arange(16 * w)] = np.ascontiguousarray(words.T).view(np.uint8)
    row, pos = np.nonzero(over)
    if len(row):
        rank = np.arange(len(row)) - (np.cumsum(n_over) - n_over)[row]
        lists = starts[row] + _BLOCK.itemsize + 16 * width[row]
        body[lists + rank] = pos
        body[(lists + n_over[row] + 4 * rank)[:, None] + np.arange(4)] = diff[row, pos].astype("<u4").view(np.uint8).reshape(-1, 4)
    return starts, body


def unpack(starts: np.ndarray, body: np.ndarray) -> np.ndarray:
    """The ids of the given blocks."""
    n = len(starts) - 1
    starts = starts.astype(np.int64)
    head = np.ascontiguousarray(body[starts[:-1, None] + np.arange(_BLOCK.itemsize)]).view(_BLOCK).reshape(n)
    width, n_over = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
    diff = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        words = np.ascontiguousarray(np.ascontiguousarray(body[(starts[rows] + _BLOCK.itemsize)[:, None] + np.arange(16 * w)]).view(np.uint64).T)
        out = np.zeros((BLOCK, len(rows)), np.uint64)
        for j in range(BLOCK):
            q, r = divmod(j * int(w), 64)
            out[j] = words[q] >> np.uint64(r)
            if r + w > 64:
                out[j] |= words[q + 1] << np.uint64(64 - r)
        diff[rows] = (out & np.uint64((1 << int(w)) - 1)).T
    row = np.repeat(np.arange(n), n_over)
    if len(row):
        rank = np.arange(len(row)) - (np.cumsum(n_over) - n_over)[row]
        lists = starts[row] + _BLOCK.itemsize + 16 * width[row]
        diff[row, body[lists + rank]] = np.ascontiguousarray(body[(lists + n_over[row] + 4 * rank)[:, None] + np.arange(4)]).view("<u4")[:, 0]
    ids = diff + head["minimum"][:, None]
    return ids.ravel()[(np.arange(BLOCK) < head["ids"][:, None]).ravel()]


class ShardWriter:
    """Writes documents to a stream as they come."""

    def __init__(self, out):
        self.out, self.docs, self.starts, self.at = out, [], [np.zeros(1, np.int64)], 0
        self.held, self.n_held, self.ids, self.n_docs = [], 0, 0, 0
        out.write(_MAGIC)

    def add(self, doc_ids: np.ndarray, has_id: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids.astype("<i8"), has_id, sizes.astype("<u8")))
        self.n_docs += len(doc_ids)
        self.ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= RUN:
            ids = np.concatenate(self.held)
            whole = len(ids) // BLOCK * BLOCK
            self._blocks(ids[:whole])
            self.held, self.n_held = [ids[whole:].copy()], len(ids) - whole

    def _blocks(self, ids: np.ndarray) -> None:
        for a in range(0, len(ids), RUN):
            starts, body = pack(ids[a : a + RUN])
            self.starts.append(starts[1:] + self.at)
            self.at += len(body)
            self.out.write(body.tobytes())

    def close(self) -> None:
        self._blocks(np.concatenate([np.zeros(0, np.uint32), *self.held]))
        doc_ids, has_id, sizes = (np.concatenate(x) for x in zip(*self.docs))
        starts = np.concatenate(self.starts).astype("<u8")
        for x in (doc_ids, np.packbits(has_id.astype(np.uint8)), sizes, starts, np.array([(self.ids, len(starts) - 1, self.n_docs, _MAGIC)], _TAIL)):
            self.out.write(x.tobytes())


class Shard:
    """A shard file that has been read."""

    def __init__(self, raw: bytes):
        tail = np.frombuffer(raw, _TAIL, 1, len(raw) - _TAIL.itemsize)[0]
        if raw[:4] != _MAGIC or tail["magic"] != _MAGIC:
            raise ValueError("not a shard of patched frame-of-reference blocks")
        n, blocks, flags = int(tail["docs"]), int(tail["blocks"]), -(-int(tail["docs"]) // 8)
        at = len(raw) - _TAIL.itemsize - 8 * (blocks + 1) - 16 * n - flags
        self.doc_ids = np.frombuffer(raw, "<i8", n, at)
        self.has_id = np.unpackbits(np.frombuffer(raw, np.uint8, flags, at + 8 * n))[:n].astype(bool)
        self.sizes = np.frombuffer(raw, "<u8", n, at + 8 * n + flags).astype(np.int64)
        self.starts = np.frombuffer(raw, "<u8", blocks + 1, at + 16 * n + flags)
        self.body = np.frombuffer(raw, np.uint8, at - 4, 4)
        self.ends = np.cumsum(self.sizes)
        if int(self.starts[-1]) != len(self.body) or self.sizes.sum() != tail["ids"]:
            raise ValueError("the shard is damaged: its counts differ")

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """The ids from ``lo`` to ``hi``: only their blocks are decoded."""
        first, last = lo // BLOCK, -(-hi // BLOCK)
        return unpack(self.starts[first : last + 1], self.body)[lo - first * BLOCK : hi - first * BLOCK]

    def runs(self):
        """(from, to) of runs of documents of about ``RUN`` ids."""
        a = 0
        while a < len(self.sizes):
            base = self.ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(self.ends, base + RUN, side="right")))
            yield a, b
            a = b


def write_shard(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    out = io.BytesIO()
    shard = ShardWriter(out)
    shard.add(doc_ids, np.ones(len(doc_ids), bool), sizes, ids)
    shard.close()
    return out.getvalue()


def read_shard(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc ids, ids per document, all ids) of a shard file."""
    shard = Shard(raw)
    return shard.doc_ids, shard.sizes, shard.ids(0, int(shard.sizes.sum()))


def document_ids(raw: bytes, index: int) -> np.ndarray:
    """The ids of the document at ``index`` of a shard: the block index leads to its blocks, no other is decoded."""
    shard = Shard(raw)
    return shard.ids(int(shard.ends[index] - shard.sizes[index]), int(shard.ends[index]))


def binaries(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    """Binary values of ``sizes`` items each, cut from an array without a copy."""
    offsets = np.concatenate([[0], np.cumsum(sizes) * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def write_token_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write shard files; a row per shard: part, seq, path, n_docs, n_ids, n_bytes.

    part and seq give the shards' order. The result is a written table: reading it does not encode again.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")

    def write(batches):
        from pyspark import TaskContext

        part, seq, shard = TaskContext.get().partitionId(), 0, None
        enc = encoder(tokenizer)

        def close():
            nonlocal seq, shard
            shard.close()
            size = shard.out.tell()
            shard.out.close()
            row = batch_of(part=pa.array([part], pa.int64()), seq=pa.array([seq], pa.int64()), path=pa.array([path]), n_docs=pa.array([shard.n_docs], pa.int64()), n_ids=pa.array([shard.ids], pa.int64()), n_bytes=pa.array([size], pa.int64()))
            seq, shard = seq + 1, None
            return row

        for batch in batches:
            doc_id, text = batch.column("doc_id"), batch.column("text")
            for a, b in sliced(text):
                if shard is None:
                    path, out = files.open_new(folder, ".pfb")
                    shard = ShardWriter(out)
                ids, sizes = enc.encode(text[a:b])
                ids = np.insert(ids.astype(np.uint32), np.cumsum(sizes), end_id)
                shard.add(doc_id[a:b].fill_null(0).to_numpy(), np.asarray(doc_id[a:b].is_valid()), sizes + 1, ids)
                if shard.ids >= SHARD_IDS:
                    yield close()
        if shard is not None:
            yield close()

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = texts(docs).withColumns({"digest": F.xxhash64("text"), "k": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(n, "doc_id", "digest", "k").sortWithinPartitions("doc_id", "digest", "k").select("doc_id", "text")
    return materialize(arrow_pass(ordered, write, "part long, seq long, path string, n_docs long, n_ids long, n_bytes long"), "shards")


def read_token_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of all documents, ids as little-endian uint32; start counts the ids of all before it."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part only
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.withColumn("part_offset", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    placed = placed.select("path", (F.col("part_start") + F.col("part_offset")).alias("base"))

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                shard = Shard(files.read_all(path))
                for a, b in shard.runs():
                    first = shard.ends[a:b] - shard.sizes[a:b]
                    ids = shard.ids(int(first[0]), int(shard.ends[b - 1])).astype("<u4")
                    yield batch_of(doc_id=pa.array(shard.doc_ids[a:b], mask=~shard.has_id[a:b]), start=pa.array(base + first, pa.int64()), ids=binaries(shard.sizes[a:b], ids))

    spread = placed.repartition(max(1, min(shards.count(), 4000)))
    return arrow_pass(spread, read, "doc_id long, start long, ids binary")
