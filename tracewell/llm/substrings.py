"""Repeated substrings by bucket-pointer refinement over sampled suffixes, exact.

Every window of ``length`` bytes (200) holds a smallest q-gram (by hash; the leftmost of equal ones). Windows that are
equal hold it at the same place, so it is enough to sort the suffixes that start at such q-grams, 1 in 77 of all, and
to carry the windows with them.

1. The q-gram at a sampled suffix is its initial bucket. A bucket of one is finished: its windows are unique.
2. Buckets are refined by a second identifier, that of all bytes from the suffix's first window to the end of its
   last, and the offsets in it. A refined bucket of two or more is finished: its windows are all repeated.
3. Where a bucket holds several refined ones, they are refined again offset by offset: per window offset, by the
   bytes of the window. One member of each refined bucket brings its bytes; members of a bucket come together sorted
   and are compared in blocks. Buckets over ``BUCKET`` members never meet in one task: their windows are parted
   by distance to the suffix, in steps of 128, 64, ... bytes; each part gets the bucket of the bytes that all windows
   of its step share, and steps 2 and 3 are used again on the parts.

Identifiers are 64-bit hashes; a window counts as repeated if both its bucket's and its own identifier agree.

Null texts are empty. Rows that share both doc_id and text count as separate copies. Null ids are an id of their own.
Extra columns are left out; an empty table gives no rows. A text of any length is one row: what is removed of it
comes together in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, materialize, texts

LENGTH = 200
Q = 48
#: members of a bucket that are compared in one block
BUCKET = 1_000
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)
#: window starts handled at once; positions inside fit in the low bits of a packed minimum
CHUNK = 1 << 22
_LOW = np.uint64((1 << 23) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the base and of its inverse, grown as texts need them."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, 2 * len(self.up))
            self.up = np.concatenate([[np.uint64(1)], np.full(n, _BASE)]).cumprod(dtype=np.uint64)
            self.down = np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]).cumprod(dtype=np.uint64)


_POWERS = Powers()


class Hashes:
    """Hashes of all substrings of a text, from one prefix sum."""

    def __init__(self, raw: bytes):
        n = len(raw)
        _POWERS.to(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[np.frombuffer(raw, np.uint8)] * _POWERS.up[:n], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * _POWERS.down[start])


def samples(h: Hashes, n: int, length: int):
    """(anchor, first window, last window): each window of ``length`` bytes belongs to the smallest q-gram in it."""
    windows = n - length + 1
    reach = length - Q + 1
    out = []
    for base in range(0, windows, CHUNK):
        count = min(CHUNK, windows - base)
        grams = np.arange(base, base + count + reach - 1)
        low = (h.of(grams, grams + Q) & ~_LOW) | (grams - base).astype(np.uint64)
        width = 1
        while 2 * width <= reach:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < reach:
            low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
        at = (low & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out.append((at[first] + base, first + base, np.concatenate([first[1:], [count]]) - 1 + base))
    return [np.concatenate(x) for x in zip(*out)]


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, t (a hash of the text: tells rows of one id apart), text."""
    return texts(docs).withColumn("t", F.xxhash64("text"))


def _suffixes(rows: DataFrame, length: int) -> DataFrame:
    """doc_id, t, bucket, whole (the second identifier), first (window), spread (anchor and last window after it)."""

    def run(batches):
        for batch in batches:
            out, index = [], []
            for k, raw in enumerate(pc.cast(batch.column("text"), pa.binary()).to_pylist()):
                if len(raw) < length:
                    continue
                h = Hashes(raw)
                anchor, first, last = samples(h, len(raw), length)
                spread = ((anchor - first) << 12) | (last - first)
                whole = mix(h.of(first, last + length) + spread.astype(np.uint64) * _M1)
                out.append((h.of(anchor, anchor + Q).view(np.int64), whole.view(np.int64), first, spread))
                index.append(np.full(len(anchor), k))
                if sum(map(len, index)) > 200_000:
                    yield _suffix_batch(batch, out, index)
                    out, index = [], []
            if out:
                yield _suffix_batch(batch, out, index)

    return arrow_pass(rows.select("doc_id", "t", "text"), run, "doc_id long, t long, bucket long, whole long, first long, spread int")


def _suffix_batch(batch, out, index) -> pa.RecordBatch:
    at = pa.array(np.concatenate(index))
    bucket, whole, first, spread = (np.concatenate(x) for x in zip(*out))
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("t").take(at), pa.array(bucket), pa.array(whole), pa.array(first.astype(np.int64)), pa.array(spread.astype(np.int32))], names=["doc_id", "t", "bucket", "whole", "first", "spread"])


def _packed(rows: DataFrame) -> DataFrame:
    """doc_id, t and the text compressed, for joins that move texts."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array([pack.compress(x) for x in pc.cast(batch.column("text"), pa.binary()).to_pylist()], pa.binary())], names=["doc_id", "t", "z"])

    return arrow_pass(rows.select("doc_id", "t", "text"), run, "doc_id long, t long, z binary")


def _bytes_of(packed: bytes, unpack) -> bytes:
    return unpack.decompress(packed)


def _on_document(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    right = right.withColumnsRenamed({"doc_id": "of_id", "t": "of_t"})
    return left.join(right, left["doc_id"].eqNullSafe(right["of_id"]) & (left["t"] == right["of_t"]), how).drop("of_id", "of_t")


def _contexts(rows: DataFrame, members: DataFrame, length: int) -> DataFrame:
    """members (doc_id, t, bucket, first, spread, hot): with the bytes of all their windows."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            ids, out, size = [], [], 0
            for k, (z, found) in enumerate(zip(batch.column("z").to_pylist(), batch.column("found").to_pylist())):
                raw = _bytes_of(z, unpack)
                for m in found:
                    out.append((m["bucket"], m["hot"], m["first"], m["spread"], raw[m["first"] : m["first"] + (m["spread"] & 4095) + length]))
                ids += [k] * len(found)
                size += len(found)
                if size > 20_000:
                    yield _context_batch(batch, ids, out)
                    ids, out, size = [], [], 0
            if out:
                yield _context_batch(batch, ids, out)

    lists = members.groupBy("doc_id", "t").agg(F.collect_list(F.struct("bucket", "hot", "first", "spread")).alias("found"))
    joined = _on_document(_packed(rows).dropDuplicates(["doc_id", "t"]), lists, "inner")
    return materialize(arrow_pass(joined.select("doc_id", "t", "z", "found"), run, "doc_id long, t long, bucket long, hot boolean, first long, spread int, bytes binary"), "contexts")


def _context_batch(batch, ids, out) -> pa.RecordBatch:
    bucket, hot, first, spread, raw = zip(*out)
    at = pa.array(ids, pa.int64())
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("t").take(at), pa.array(bucket, pa.int64()), pa.array(hot), pa.array(first, pa.int64()), pa.array(spread, pa.int32()), pa.array(raw, pa.binary())], names=["doc_id", "t", "bucket", "hot", "first", "spread", "bytes"])


def _aligned(spread: np.ndarray, raws: list[bytes], length: int):
    """Prefix hashes of members' bytes with all anchors in one column, and how far each starts before its anchor."""
    reach, left = length - Q, spread >> 12
    wide = np.zeros((len(raws), reach + length), np.uint8)  # anchors stand at column ``reach``
    for k, raw in enumerate(raws):
        wide[k, reach - left[k] : reach - left[k] + len(raw)] = np.frombuffer(raw, np.uint8)
    _POWERS.to(reach + length + 1)
    prefix = np.zeros((len(raws), reach + length + 1), np.uint64)
    np.cumsum(_BYTE[wide] * _POWERS.up[: reach + length], axis=1, out=prefix[:, 1:])
    return prefix, left


def window_keys(bucket: np.ndarray, spread: np.ndarray, raws: list[bytes], length: int):
    """For each window of each member: the member's row, the window's number in it, and its key."""
    prefix, left = _aligned(spread, raws, length)
    reach, count = length - Q, (spread & 4095) + 1
    row = np.repeat(np.arange(len(raws)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    column = (reach - left)[row] + number
    own = mix(prefix[row, column + length] - prefix[row, column])
    return row, number, mix(own + bucket.view(np.uint64)[row] * _M2 + column.astype(np.uint64) * _M1)


def _runs(row: np.ndarray, number: np.ndarray):
    """(row, first, last) of runs of numbers that follow each other."""
    cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (number[1:] != number[:-1] + 1)])) if len(row) else np.zeros(0, int)
    last = np.concatenate([cut[1:], [len(row)]])[: len(cut)] - 1
    return row[cut], number[cut], number[last]


_SPANS = "doc_id long, t long, first long, last long"


def _refine_blocks(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of members of buckets of bounded size; members come sorted by bucket."""

    def block(rows):
        bucket = np.array(rows["bucket"], np.int64)
        row, number, key = window_keys(bucket, np.array(rows["spread"], np.int64), rows["bytes"], length)
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        hit = count[which] > 1
        r, a, b = _runs(row[hit], number[hit])
        first = np.array(rows["first"], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([rows["doc_id"][k] for k in r], pa.int64()), pa.array([rows["t"][k] for k in r], pa.int64()), pa.array(first[r] + a, pa.int64()), pa.array(first[r] + b, pa.int64())], names=["doc_id", "t", "first", "last"])

    def run(batches):
        held = None
        for batch in batches:
            rows = {c: batch.column(c).to_pylist() for c in ("doc_id", "t", "bucket", "first", "spread", "bytes")}
            held = rows if held is None else {c: held[c] + rows[c] for c in held}
            last = held["bucket"][-1] if held["bucket"] else None
            cut = next((k + 1 for k in range(len(held["bucket"]) - 1, -1, -1) if held["bucket"][k] != last), 0)
            if cut:  # the last bucket may go on
                yield block({c: v[:cut] for c, v in held.items()})
                held = {c: v[cut:] for c, v in held.items()}
        if held and held["bucket"]:
            yield block(held)

    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = contexts.where("not hot").drop("hot").repartition(n, "bucket").sortWithinPartitions("bucket")
    return arrow_pass(sorted_, run, _SPANS)


def _parts(contexts: DataFrame, length: int, width: int) -> DataFrame:
    """Members with their windows parted by distance to the anchor, in steps of ``width``; each part has the bucket of
    the bytes that all windows of its step share, which members with fewer windows in the step also have."""

    def run(batches):
        for batch in batches:
            bucket, spread, raws = batch.column("bucket").to_numpy(), batch.column("spread").to_numpy().astype(np.int64), batch.column("bytes").to_pylist()
            if not len(raws):
                continue
            prefix, left = _aligned(spread, raws, length)
            near = left - (spread & 4095)  # the last window's distance; the first one's is left
            steps = left // width - near // width + 1
            row = np.repeat(np.arange(len(raws)), steps)
            step = (near // width)[row] + np.arange(len(row)) - np.repeat(np.cumsum(steps) - steps, steps)
            low = left[row] - np.minimum(left[row], step * width + width - 1)
            high = left[row] - np.maximum(near[row], step * width)
            anchor = length - Q
            shared = mix(prefix[row, anchor - step * width - width + 1 + length] - prefix[row, anchor - step * width])
            own = mix(shared + bucket.view(np.uint64)[row] * _M2 + step.astype(np.uint64) * _M1)
            at = anchor - left[row]
            whole = mix(prefix[row, at + high + length] - prefix[row, at + low] + ((left[row] - low) * 4096 + high - low).astype(np.uint64) * _M2)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("t").take(take), pa.array(own.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(batch.column("first").to_numpy()[row] + low), pa.array((((left[row] - low) << 12) | (high - low)).astype(np.int32)), pa.array([raws[r][a : b + length] for r, a, b in zip(row.tolist(), low.tolist(), high.tolist())], pa.binary())],
                names=["doc_id", "t", "bucket", "whole", "first", "spread", "bytes"],
            )

    return arrow_pass(contexts.select("doc_id", "t", "bucket", "first", "spread", "bytes"), run, "doc_id long, t long, bucket long, whole long, first long, spread int, bytes binary")


def _spans(members: DataFrame) -> DataFrame:
    return members.select("doc_id", "t", "first", (F.col("first") + F.col("spread").bitwiseAND(4095)).alias("last"))


def _refine(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of members (doc_id, t, bucket, hot, first, spread, bytes); large buckets are parted until small."""
    out = _refine_blocks(contexts, length)
    width = 128
    while not contexts.where("hot").isEmpty():
        parts = materialize(_parts(contexts.where("hot"), length, width), "parts")
        width = max(1, width // 2)
        refined = parts.groupBy("bucket", "whole").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "t", "first", "spread", "bytes")).alias("one"))
        refined = materialize(refined, "refined")
        equal = materialize(refined.where("n > 1").select("bucket", "whole"), "refined")
        out = out.unionByName(_spans(parts.join(equal, ["bucket", "whole"], "left_semi")))
        contexts = materialize(refined.join(_several(refined), "bucket").select("one.*", "bucket", "hot"), "contexts")
        out = out.unionByName(_refine_blocks(contexts, length))
    return out


def _several(refined: DataFrame) -> DataFrame:
    """Buckets of two or more refined ones, and whether they are large."""
    members = refined.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    return materialize(members.select("bucket", (F.col("members") > BUCKET).alias("hot")), "several")


def repeated_windows(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, t, first, last): runs of windows that also start elsewhere."""
    suffixes = _suffixes(rows, length)
    common = suffixes.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    common = materialize(common, "buckets")
    shared = materialize(suffixes.join(common, "bucket", "left_semi"), "shared")
    refined = shared.groupBy("bucket", "whole").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "t", "first", "spread")).alias("one"))
    refined = materialize(refined, "refined")
    members = refined.join(_several(refined), "bucket").select("one.*", "bucket", "hot")
    contexts = _contexts(rows, members, length)
    equal = refined.where("n > 1").select("bucket", "whole")
    return _spans(shared.join(equal, ["bucket", "whole"], "left_semi")).unionByName(_refine(contexts, length))


def cut(raw: bytes, first: np.ndarray, last: np.ndarray, length: int) -> tuple[bytes, int, int]:
    """What is left, the bytes removed and the runs of removed bytes, for windows first..last that are repeated."""
    change = np.zeros(len(raw) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, last + length, -1)
    gone = np.cumsum(change[:-1]) > 0
    starts = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(raw) else 0
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), starts


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that are left)."""
    rows = _rows(docs)
    spans = repeated_windows(rows, length).groupBy("doc_id", "t").agg(F.collect_set(F.struct("first", "last")).alias("found"))

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            n, removed, runs, kept = [], [], [], []
            lists = batch.column("found")
            for k, z in enumerate(batch.column("z").to_pylist()):
                raw = _bytes_of(z, unpack)
                n.append(len(raw))
                found = lists[k]
                if found.is_valid:
                    ends = found.values
                    left, gone, spans = cut(raw, ends.field("first").to_numpy(), ends.field("last").to_numpy(), length)
                else:
                    left, gone, spans = raw, 0, 0
                removed.append(gone)
                runs.append(spans)
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = _on_document(_packed(rows), spans, "left").select("doc_id", "z", "found")
    return arrow_pass(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
