"""N-gram Jaccard join in the metric space of shingle sets (distance 1 - Jaccard), exact.

With whole documents as the only pivots nearly every distance is 1, every window of twice the radius reaches every
pivot, and every region holds the whole corpus. So the first regions come from parts of the sets: the shingles of a set
are dealt by hash into m parts. Two sets within the radius differ in at most d shingles, so at least m - d of their
parts are the same in both; a set therefore leaves its m - d - 1 lightest parts out and still shares a part with each
set it is linked with. The value of a part is the pivot of a region with a window of zero; m depends on the size, and
documents near the lower end of a band of sizes also go to the band below (the triangle-inequality window around the
empty set, whose distance is the size). Regions of one set are left out by a count of packed prefixes of their keys.

Inside a region documents are close, and pivots are documents. First each document meets one pivot, the most central
document of its regions, so a group of copies falls into one component whatever the number of regions it fills; a
region whose documents are then in one component is finished. Of the others, those of more than ``SMALL`` documents
become one where they have the same central pivot, and draw ``PIVOTS`` pivots, whose exact distances to all others are taken, and are split into the pivots' Voronoi regions
and, inside these, into shells one radius wide; a document also goes to every region whose pivot is at most two radii
farther than its own, and to the neighbouring shells, so no link is lost; pivots have met all others and leave. The
parts are joined again recursively. Smaller regions, and those that a split does not part, are compared in blocks:
bit sketches first (each shingle flips one bit, so sets differ at least as much as sketches), of which a block gives
out the closest pair of each two components; then exactly, and then the pairs that these links leave apart.

Sets that are equal form a class, of which one document takes part. Documents without words are linked with nothing.
Null texts have no words. Rows that share a doc_id are one document in links, as are those without one; a null
doc_id counts as larger than all others and is returned as null. Extra columns are left out; an empty table gives no
rows. A text of any length is one set, held by its task at eight bytes a shingle. Of equally central documents a hash
draws the pivot; the components do not depend on it. Tables of a round are removed when the next is written.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, arrow_pass, batch_of, bitmap, has, materialize, release, texts
from .components import relabel

#: documents of a region that are compared directly: half a million pairs of sketches
SMALL = 1024
PIVOTS = 8
#: documents of one region that a block holds
TILE = 2048
#: pairs of sketches compared at once
PAIRS = 100_000
#: 64-bit words of a bit sketch
SKETCH = 16
BAND = 1.5
#: parts beyond those in which linked sets can differ, as a share of these; as many of the lightest are left out
SPARE = 0.3
#: keys of a bucket that a task looks through at once, about
BUCKET_KEYS = 4_000_000
#: rows of a batch of pairs of sets
PAIR_ROWS = 200
#: words whose hashes a worker keeps
WORDS = 50_000
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MUL[3]
    x = (x ^ (x >> np.uint64(29))) * _MUL[4]
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """64-bit hashes of words: at most ``WORDS``, as they stay in the worker when its task has ended."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a UTF-8 text, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    x = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        x = _mix(x * _MUL[0] + h[i : i + len(x)] * _MUL[i % 3])
    return np.unique(x)


def most_apart(sum_of_sizes: int, percent: int) -> int:
    """The most shingles in which two sets with these many shingles together can differ and still be linked."""
    return sum_of_sizes - 2 * -(-percent * sum_of_sizes // (100 + percent))


def fingerprint(x: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that tell sets apart."""
    return tuple(int(_mix(x * m).sum(dtype=np.uint64).astype(np.int64)) for m in (np.uint64(1), _MUL[2]))


@functools.cache
def bands(percent: int, largest: int):
    """(smallest size, next band's smallest size, number of parts that a set shows) of the bands up to a size."""
    lo = max(1, -(-percent // (100 - percent)))  # smaller sets are linked only if equal
    out = []
    while lo <= largest:
        hi = max(lo + 1, int(lo * BAND))
        top = (hi - 1) + (hi - 1) * 100 // percent
        out.append((lo, hi, 1 + max(most_apart(s, percent) for s in range(max(1, top - 40), top + 1))))
        lo = hi
    return out


def part_keys(x: np.ndarray, percent: int) -> np.ndarray:
    """A key for each part that a set shows, in its own band and in that below if a smaller set there could be linked.

    Of ``shown + spare`` parts the ``spare`` lightest are left out (of equal ones those with the larger number), which
    linked sets do alike as far as their parts are the same.
    """
    n, out = len(x), []
    for lo, hi, shown in bands(percent, n):
        if not (lo <= n and 100 * (hi - 1) >= percent * n):
            continue
        parts = shown + int(SPARE * shown)
        part = (_mix(x + np.uint64(lo)) >> np.uint64(11)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        value = np.concatenate([[np.uint64(0)], np.cumsum(_mix(x[order] * _MUL[1]))])
        edge = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        sums = value[edge[1:]] - value[edge[:-1]]
        keys = _mix(sums + np.arange(parts, dtype=np.uint64) * _MUL[2] + np.array([lo], np.uint64) * _MUL[0])
        out.append(keys[np.argsort(edge[:-1] - edge[1:], kind="stable")[:shown]])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketch(x: np.ndarray) -> np.ndarray:
    """Bits that the shingles of a set flip, as words."""
    size = 64 * SKETCH
    flips = np.bincount((_mix(x + _MUL[4]) % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def long_sketch(x: np.ndarray) -> bytes:
    """As ``sketch``, of two to four bits a shingle (a power of two in all): it does not fill up with the set's size."""
    size = 1 << max(10, (2 * len(x) - 1).bit_length())
    flips = np.bincount((_mix(x + _MUL[4]) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def long_apart(one: bytes, other: bytes) -> int:
    """Places in which two long sketches differ, the longer one folded: at most the shingles in which the sets differ."""
    a, b = sorted((np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum(dtype=np.int64))


def _sets_pass(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """doc, row (a hash of the row), n, f1, f2 (fingerprint of the set), the keys of its parts, and its bit sketch."""

    def run(batches):
        for batch in batches:
            n, f1, f2, keys, bits = [], [], [], [], []
            for raw in pc.cast(batch.column("text"), pa.binary()).to_pylist():
                x = shingles(raw, width)
                n.append(len(x))
                a, b = fingerprint(x)
                f1.append(a)
                f2.append(b)
                keys.append(part_keys(x, percent).view(np.int64))
                bits.append(sketch(x))
            if n:
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys)))
                sketches = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * SKETCH), pa.array(np.concatenate(bits)))
                yield batch_of(doc=batch.column("doc_id"), row=batch.column("row"), n=pa.array(n, pa.int64()), f1=pa.array(f1, pa.int64()), f2=pa.array(f2, pa.int64()), keys=lists, sketch=sketches)

    return materialize(arrow_pass(rows, run, "doc long, row long, n long, f1 long, f2 long, keys array<long>, sketch array<long>"), "sets", BATCH_ROWS)


def _packed(values: np.ndarray) -> bytes:
    """Sorted 32-bit values as differences, byte by byte: of a batch's keys the upper bytes are mostly zero and vanish."""
    return np.diff(values, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint32)


def _shared_prefixes(sets: DataFrame, classes: DataFrame) -> tuple[DataFrame, int]:
    """(prefix) of keys that stand in two different sets, and the bits that a prefix has.

    Keys are dealt by their first bits to buckets of some ``BUCKET_KEYS`` and sent as the next 32 bits, packed: about
    three bytes a key. Keys of different value may have one prefix, and a row of no class may pass the filter of rows;
    then a prefix more is called shared, never one less. Of the rows of one set one sends its keys.
    """
    total = sets.agg(F.sum(F.size("keys"))).first()[0] or 0
    bits = max(8, -(-total // BUCKET_KEYS).bit_length())
    shared = sets.sparkSession.sparkContext.broadcast(bitmap(classes.select("row")))

    def deal(batches):
        for batch in batches:
            lists = batch.column("keys").filter(pa.array(has(shared.value, batch.column("row").to_numpy())))
            prefix = np.sort(lists.flatten().to_numpy().view(np.uint64) >> np.uint64(32 - bits))
            bucket = (prefix >> np.uint64(32)).astype(np.int32)
            edge = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(prefix))
            keys = [_packed(prefix[i:j].astype(np.uint32)) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())]
            yield batch_of(bucket=pa.array(bucket[edge[:-1]]), keys=pa.array(keys, pa.binary()))

    def several(bucket, held):
        values = np.sort(np.concatenate(held))
        twice = np.unique(values[1:][values[1:] == values[:-1]]).astype(np.int64)
        return batch_of(prefix=pa.array(twice + (np.int64(bucket) << 32)))

    def meet(batches):
        at, held = None, []
        for batch in batches:
            for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("keys").to_pylist()):
                if bucket != at and held:
                    yield several(at, held)
                    held = []
                at = bucket
                held.append(_unpacked(raw))
        if held:
            yield several(at, held)

    dealt = arrow_pass(sets.select("row", "keys"), deal, "bucket int, keys binary").repartition("bucket").sortWithinPartitions("bucket")
    return materialize(arrow_pass(dealt, meet, "prefix long"), "shared"), bits


def _with_keys_in(sets: DataFrame, prefixes: DataFrame, bits: int) -> DataFrame:
    """f1, f2, n, cell, prefix: the sets' keys, without most of those whose prefix is not in ``prefixes`` (a filter, not a join)."""
    shared = sets.sparkSession.sparkContext.broadcast(bitmap(prefixes))

    def run(batches):
        words = shared.value
        for batch in batches:
            lists = batch.column("keys")
            cell = lists.flatten().to_numpy()
            prefix = (cell.view(np.uint64) >> np.uint64(32 - bits)).view(np.int64)
            hit = has(words, prefix)
            take = pa.array(np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))[hit])
            yield batch_of(**{c: batch.column(c).take(take) for c in ("f1", "f2", "n")}, cell=pa.array(cell[hit]), prefix=pa.array(prefix[hit]))

    return arrow_pass(sets.select("f1", "f2", "n", "keys"), run, "f1 long, f2 long, n long, cell long, prefix long").distinct()


class _Shingles:
    """Shingle hashes (node, n, long, x) of those nodes that comparisons have asked for, made from the texts when they
    first do; n is their number and long their long sketch."""

    def __init__(self, rows: DataFrame, about: DataFrame, width: int):
        self.rows, self.about, self.width, self.tables = rows, about, width, []

    def of(self, nodes: DataFrame) -> DataFrame:
        """A table with at least ``nodes`` (node)."""
        missing = nodes.distinct()
        for held in self.tables:
            missing = missing.join(held.select("node"), "node", "left_anti")
        missing = materialize(missing.join(self.about.select("node", "row", "f1"), "node"), "missing")
        if not missing.isEmpty():
            self.tables.append(self._read(missing))
        release(missing)
        return functools.reduce(DataFrame.unionByName, self.tables) if self.tables else nodes.sparkSession.createDataFrame([], "node long, n long, long binary, x binary")

    def _read(self, wanted: DataFrame) -> DataFrame:
        width, shared = self.width, wanted.sparkSession.sparkContext.broadcast(bitmap(wanted.select("row")))

        def run(batches):
            seen = set()  # repeated rows of a task give their hashes once
            for batch in batches:
                row = batch.column("row").to_numpy()
                hits = [i for i in np.flatnonzero(has(shared.value, row)).tolist() if row[i] not in seen]
                hits = list({row[i]: i for i in hits}.values())
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.update(row[i] for i in hits)
                for k in range(0, len(hits), PAIR_ROWS):
                    part = hits[k : k + PAIR_ROWS]
                    xs = [shingles(raw, width) for raw in pc.cast(batch.column("text").take(pa.array(part)), pa.binary()).to_pylist()]
                    about = {"f1": pa.array([fingerprint(x)[0] for x in xs], pa.int64()), "n": pa.array([len(x) for x in xs], pa.int64()), "long": pa.array([long_sketch(x) for x in xs], pa.binary())}
                    yield batch_of(row=pa.array(row[part]), **about, x=pa.array([x.tobytes() for x in xs], pa.binary()))

        found = arrow_pass(self.rows.select("row", "text"), run, "row long, f1 long, n long, long binary, x binary")
        # a row is of one node; by the keys of the join, so the hashes are dealt out once
        return materialize(found.join(wanted, ["row", "f1"]).dropDuplicates(["row", "f1"]).select("node", "n", "long", "x"), "shingles")

    @staticmethod
    def _of_nodes(x: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
        """The rows of ``x`` that a filter of ``nodes`` (node) lets pass."""
        words = x.sparkSession.sparkContext.broadcast(bitmap(nodes.select(F.xxhash64("node").alias("key"))))

        @F.pandas_udf("boolean")
        def may(keys: pd.Series) -> pd.Series:
            return pd.Series(has(words.value, keys.to_numpy()))

        return x.select("node", *columns).where(may(F.xxhash64("node")))

    def near(self, pairs: DataFrame, percent: int) -> DataFrame:
        """The pairs (a, b) whose long sketches allow a link: no linked pair is left out."""

        def run(batches):
            for batch in batches:
                both = zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "long_a", "long_b")))
                ok = pa.array([long_apart(la, lb) <= most_apart(n + m, percent) for n, m, la, lb in both], pa.bool_())
                yield batch_of(a=batch.column("a").filter(ok), b=batch.column("b").filter(ok))

        x = self.of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        side = lambda c: x.select(F.col("node").alias(c), F.col("n").alias("n_" + c), F.col("long").alias("long_" + c))
        return materialize(arrow_pass(pairs.join(side("a"), "a").join(side("b"), "b"), run, "a long, b long"), "near", BATCH_ROWS)

    def linked(self, pairs: DataFrame, percent: int) -> DataFrame:
        """The pairs (a, b) that are linked. Sets are sent only for pairs whose long sketches allow it, a fraction of
        their size; the sketches of regions are too short to part large sets."""
        near = self.near(pairs, percent)
        known = self.distances(near)
        out = materialize(known.where(_linked(percent)).select("a", "b"), "linked")
        release(near, known)
        return out

    def distances(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b): a, b, inside (shingles in both), every (in either)."""

        def run(batches):
            for batch in batches:
                inside, every = [], []
                last, y = None, None
                for raw, other in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist()):
                    x = np.frombuffer(raw, np.uint64)
                    if other is not last:
                        last, y = other, np.frombuffer(other, np.uint64)
                    at = np.searchsorted(y, x)
                    at[at == len(y)] = 0
                    k = int((y[at] == x).sum()) if len(y) else 0
                    inside.append(k)
                    every.append(len(x) + len(y) - k)
                yield batch_of(a=batch.column("a"), b=batch.column("b"), inside=pa.array(inside, pa.int64()), every=pa.array(every, pa.int64()))

        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        x = self._of_nodes(self.of(nodes), nodes, "x")
        xa, xb = x.select(F.col("node").alias("a"), F.col("x").alias("xa")), x.select(F.col("node").alias("b"), F.col("x").alias("xb"))
        return materialize(arrow_pass(pairs.join(xa, "a").join(xb, "b"), run, "a long, b long, inside long, every long", PAIR_ROWS), "distances", PAIR_ROWS)

    def release(self) -> None:
        release(*self.tables)


def _linked(percent: int):
    return F.col("inside") * 100 >= F.col("every") * percent


def _merge_equal_regions(members: DataFrame) -> DataFrame:
    """Of regions with the same documents one is kept."""
    of = members.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").bitwiseAND(F.lit(2**40 - 1))).alias("s"), F.bit_xor(F.xxhash64(F.col("node"), F.lit(7))).alias("x"), F.min("node").alias("least"))
    kept = materialize(of.groupBy("n", "s", "x", "least").agg(F.min("cell").alias("cell")).select("cell"), "regions")
    out = materialize(members.join(kept, "cell", "left_semi"), "members")
    release(kept)
    return out


def _apart(a: str, b: str):
    """Places in which two sketches differ: at most the shingles in which the sets differ."""
    return sum((F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))) for i in range(SKETCH)), F.lit(0))


def _may_link(percent: int):
    both = F.col("size_a") + F.col("size_b")
    return _apart("sketch_a", "sketch_b") <= both - 2 * F.ceil(both * percent / (100 + percent))


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    out = relabel(labels, links)
    if out is not labels:
        release(labels)
    return out


def _link_to_pivots(members: DataFrame, about: DataFrame, labels: DataFrame, sets: _Shingles, percent: int) -> DataFrame:
    """Compares each document with one pivot: the most central document of its regions.

    Central is a document that shares most of its parts with others, as the one that copies were made from does; so
    the copies of a group meet one pivot, in one comparison each, whatever the number of regions they share.
    """
    ranked = members.join(about.select("node", "rank"), "node")
    firsts = materialize(ranked.groupBy("cell").agg(F.min(F.struct("rank", "node")).alias("first")), "firsts")
    pairs = members.join(firsts, "cell").groupBy("node").agg(F.min("first").alias("first")).select(F.col("node").alias("a"), F.col("first.node").alias("b")).where("a <> b")
    side = lambda x: about.select(*[F.col(c).alias(n) for c, n in (("node", x), ("size", "size_" + x), ("sketch", "sketch_" + x))])
    likely = materialize(pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link(percent)).select("a", "b"), "likely")
    links = sets.linked(likely, percent)
    labels = _merge(labels, links)
    release(firsts, likely, links)
    return labels


def _active(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members with label and n (documents of the region), of the regions that hold more than one component."""
    placed = members.join(labels, "node")
    state = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("cell", "n")
    return placed.join(state, "cell")


def _merge_by_pivot(active: DataFrame, about: DataFrame) -> DataFrame:
    """Large regions with the same central pivot become one: a group of near copies fills hundreds of regions with nearly
    the same documents, which are then taken up once and not in each."""
    small, large = active.where(F.col("n") <= SMALL), active.where(F.col("n") > SMALL)
    firsts = large.join(about.select("node", "rank"), "node").groupBy("cell").agg(F.min(F.struct("rank", "node")).alias("first"))
    merged = large.join(firsts, "cell").select(F.xxhash64("first.node", F.lit("merged")).alias("cell"), "node").distinct()
    return small.select("cell", "node").unionByName(merged)


def _split_large(members: DataFrame, about: DataFrame, labels: DataFrame, sets: _Shingles, percent: int) -> tuple[DataFrame, DataFrame]:
    """Joins regions of more than ``SMALL`` documents at pivots and splits them, again and again.

    Gives the labels so far and the regions left: those that are small, and those that pivots do not part.
    """
    radius = 1 - percent / 100 + 1e-9
    done, turn = [], 0
    members = materialize(_merge_by_pivot(_active(members, labels), about).withColumn("stuck", F.lit(False)), "members")
    while True:
        active = materialize(_active(members, labels), "active")
        direct = F.col("stuck") | (F.col("n") <= SMALL)
        done.append(active.where(direct).select("cell", "node"))
        large = active.where(~direct)
        if large.isEmpty():
            return labels, functools.reduce(DataFrame.unionByName, done)
        # the draw depends on the document alone, so regions that hold the same documents have the same pivots
        chance = F.pmod(F.xxhash64(F.col("node"), F.lit(turn), F.lit("pivot")), F.lit(1_000_003)) / 1_000_003.0
        first = large.groupBy("cell").agg(F.min_by("node", F.xxhash64(F.col("node"), F.lit(turn), F.lit("first"))).alias("first"))
        drawn = materialize(large.join(first, "cell").select("cell", "node", ((F.col("node") == F.col("first")) | (chance < F.lit(PIVOTS) / F.col("n"))).alias("pivot")), "drawn")
        pivots = drawn.where("pivot").select("cell", F.col("node").alias("b"))
        met = drawn.join(pivots, "cell").where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b").distinct()
        met = materialize(met, "met")
        known = sets.distances(met)
        labels = _merge(labels, known.where(_linked(percent)).select("a", "b"))
        parts = _split(drawn.where("not pivot").select("cell", "node"), pivots, known, radius)
        release(drawn, met, known, members)
        members, turn = parts, turn + 1


def _split(rest: DataFrame, pivots: DataFrame, known: DataFrame, radius: float) -> DataFrame:
    """Voronoi regions and shells of the documents that are left; a region that they do not part stays and is stuck."""
    by_pivot = rest.select("cell", F.col("node").alias("a")).join(pivots, "cell").join(known, ["a", "b"])
    by_pivot = materialize(by_pivot.select("cell", "a", "b", (1 - F.col("inside") / F.col("every")).alias("d")), "split")
    home = by_pivot.groupBy("cell", "a").agg(F.min("d").alias("nearest"))
    near = by_pivot.join(home, ["cell", "a"]).where(F.col("d") <= F.col("nearest") + 2 * radius)
    near = materialize(near.select(F.col("cell").alias("was"), "b", F.floor(F.col("d") / radius).alias("shell"), F.col("a").alias("node")), "split")
    # rows that would meet: the sum of squares over the parts (a shell with its neighbours) against the square of the whole
    shells = near.groupBy("was", "b", "shell").agg(F.count("*").alias("k"))
    about_shell = shells.select("was", "b", F.explode(F.array(*[F.struct((F.col("shell") + d).alias("shell"), "k") for d in (-1, 0, 1)])).alias("s")).groupBy("was", "b", "s.shell").agg(F.sum("s.k").alias("k"))
    parts = about_shell.groupBy("was").agg(F.sum(F.col("k") * F.col("k")).alias("parts"))
    whole = rest.groupBy(F.col("cell").alias("was")).agg((F.count("*") * F.count("*")).alias("whole"))
    good = materialize(whole.join(parts, "was").where("parts < 0.7 * whole").select("was"), "split")
    # only what is worth it is dealt out
    dealt = near.join(good, "was", "left_semi").withColumn("shell", F.explode(F.array(F.col("shell") - 1, F.col("shell"), F.col("shell") + 1)))
    dealt = dealt.select(F.xxhash64("was", "b", "shell").alias("cell"), "node", F.lit(False).alias("stuck")).distinct()
    kept = rest.select(F.col("cell").alias("was"), "node").join(good, "was", "left_anti").select(F.col("was").alias("cell"), "node", F.lit(True).alias("stuck"))
    out = materialize(kept.unionByName(dealt), "members")
    release(by_pivot, near, good)
    return out


def close_pairs(size: np.ndarray, sketches: np.ndarray, label: np.ndarray, tile: np.ndarray, ends: np.ndarray, percent: int):
    """Rows i < j of one region (``ends`` is where the region of each row ends) whose sketches allow a link and whose
    labels differ: i, j, places apart. Sketches are unsigned. With two tiles in a region, rows of one tile do not meet."""
    both = np.arange(0, 2 * int(size.max(initial=0)) + 1)
    most = both - 2 * -(-percent * both // (100 + percent))
    count = ends - np.arange(len(ends)) - 1
    upto = np.cumsum(count)
    out, a = [], 0
    while a < len(ends):
        base = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, base + PAIRS, side="right")))
        i = np.repeat(np.arange(a, b), count[a:b])
        j = np.arange(len(i)) - np.repeat(upto[a:b] - count[a:b] - base, count[a:b]) + i + 1
        ok = (label[i] != label[j]) & ((tile[i] != tile[j]) | (tile[i] < 0))
        i, j = i[ok], j[ok]
        apart = np.bitwise_count(sketches[i] ^ sketches[j]).sum(axis=1, dtype=np.int64)
        ok = apart <= most[size[i] + size[j]]
        out.append((i[ok], j[ok], apart[ok]))
        a = b
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _candidates(regions: DataFrame, about: DataFrame, labels: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs (a, b) with la, lb, apart of documents of a region that may be linked and are in different components.

    Regions are compared in blocks of at most ``TILE`` documents of one region against as many others. With ``best``
    a block gives only the closest pair of each two components.
    """
    active = _active(regions, labels).join(about.select("node", "size", "sketch"), "node")
    tiles = F.greatest(F.lit(1), F.ceil(F.col("n") / TILE)).cast("int")
    active = active.withColumns({"tiles": tiles, "own": F.pmod(F.xxhash64(F.col("node"), F.lit(11)), tiles).cast("int")})
    columns = ["cell", "lo", "hi", "own", "node", "label", "size", "sketch"]
    alone = active.where("tiles = 1").withColumns({"lo": F.lit(-1), "hi": F.lit(-1), "own": F.lit(-1)}).select(columns)
    other = active.where("tiles > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    other = other.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other"), "own": F.when(F.col("own") == F.col("other"), F.lit(-1)).otherwise(F.col("own"))})
    # rows that meet within a tile have no tile of their own (-1); in a block of two tiles only rows of different ones meet
    blocks = alone.unionByName(other.select(columns))

    def run(batches):
        held = None
        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            key = [rows.column(c).to_numpy() for c in ("cell", "lo", "hi")]
            new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)]))
            yield from compare(rows.slice(0, int(new[-1])))
            held = pa.concat_batches([rows.slice(int(new[-1]))])
        if held is not None:
            yield from compare(held)

    def compare(rows):
        if not len(rows):
            return
        at = {c: rows.column(c).to_numpy() for c in ("cell", "lo", "hi", "own", "node", "label", "size")}
        new = np.flatnonzero(np.concatenate([[True], np.any([at[c][1:] != at[c][:-1] for c in ("cell", "lo", "hi")], axis=0)]))
        ends = np.repeat(np.append(new[1:], len(rows)), np.diff(np.append(new, len(rows))))
        i, j, apart = close_pairs(at["size"], rows.column("sketch").flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH), at["label"], at["own"], ends, percent)
        i, j = np.where(at["node"][i] < at["node"][j], i, j), np.where(at["node"][i] < at["node"][j], j, i)
        la, lb, a, b = at["label"][i], at["label"][j], at["node"][i], at["node"][j]
        x, y = np.minimum(la, lb), np.maximum(la, lb)
        if best:
            order = np.lexsort((b, a, apart, y, x))
            first = np.concatenate([[True], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])]) if len(order) else np.zeros(0, bool)
            take = order[first]
        else:
            take = np.unique(np.stack([a, b]), axis=1, return_index=True)[1]
        yield batch_of(**{c: pa.array(v[take]) for c, v in {"a": a, "b": b, "x": x, "y": y, "apart": apart}.items()})

    dealt = blocks.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
    return arrow_pass(dealt, run, "a long, b long, x long, y long, apart long")


def _link_direct(regions: DataFrame, about: DataFrame, labels: DataFrame, sets: _Shingles, percent: int) -> DataFrame:
    """Compares the closest pair of each two components exactly; then all pairs that these links leave in different ones."""
    found = _candidates(regions, about, labels, percent, best=True).groupBy("x", "y").agg(F.min(F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b")
    first = materialize(found, "pairs")
    links = sets.linked(first, percent)
    labels = _merge(labels, links)
    rest = materialize(_candidates(regions, about, labels, percent, best=False).select("a", "b").distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        others = sets.linked(rest, percent)
        labels = _merge(labels, others)
        release(others)
    release(first, links, rest)
    return labels


def _same_document(narrow: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of rows that share a doc_id."""
    several = narrow.groupBy("doc").agg(F.min("f1").alias("low"), F.max("f1").alias("high")).where("low <> high").select("doc")
    rows = narrow.alias("r").join(several.alias("s"), F.col("r.doc").eqNullSafe(F.col("s.doc")), "left_semi").distinct()
    nodes = rows.join(classes.select("f1", "f2", "n", "node"), ["f1", "f2", "n"]).select("doc", "node")
    least = nodes.groupBy("doc").agg(F.min("node").alias("b"))
    return nodes.alias("r").join(least.alias("s"), F.col("r.doc").eqNullSafe(F.col("s.doc"))).select(F.col("node").alias("a"), "b").where("a <> b")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), class_id (smallest with an equal set)."""
    rows = texts(docs)
    rows = rows.select("doc_id", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("row"), "text")
    sets = _sets_pass(rows, width, percent)
    narrow = materialize(sets.select("doc", "n", "f1", "f2"), "narrow")
    smallest = F.min(F.struct(F.col("doc").isNull(), "doc"))  # a null is the largest
    classes = sets.where("n > 0").groupBy("f1", "f2", "n").agg(smallest.alias("rep"), F.min("row").alias("row"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    shared, bits = _shared_prefixes(sets, classes)
    named = classes.select("f1", "f2", "n", "node")
    found = materialize(_with_keys_in(sets, shared, bits).join(shared, "prefix", "left_semi").join(named, ["f1", "f2", "n"]).select("cell", "node"), "members")
    central = found.groupBy("node").agg(F.count("*").alias("k")).join(classes.select("node", "f1", "f2", "n", "row"), "node")
    own = sets.select("row", "f1", "f2", "n", F.size("keys").alias("keys"), "sketch")
    # 32 steps of the share of keys that others have too, most first; a hash tells equal ones apart
    rank = F.shiftleft(31 - F.least(F.lit(31), F.floor(F.col("k") * 32 / F.col("keys"))), 58) + F.shiftrightunsigned(F.xxhash64("node"), 6)
    about = central.join(own, ["row", "f1", "f2", "n"]).select("node", "row", "f1", F.col("n").alias("size"), "sketch", rank.alias("rank")).dropDuplicates(["node"])
    about = materialize(about, "about")
    release(sets, shared)
    members = _merge_equal_regions(found)
    release(found)
    same = materialize(_same_document(narrow.where("n > 0"), classes), "same")
    labels = about.select("node").unionByName(same.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    labels = materialize(labels.select("node", F.col("node").alias("label")), "labels")
    if not same.isEmpty():
        labels = _merge(labels, same)
    hashes = _Shingles(rows, about, width)
    labels = _link_to_pivots(members, about, labels, hashes, percent)
    labels, regions = _split_large(members, about, labels, hashes, percent)
    labels = _link_direct(regions, about, labels, hashes, percent)
    hashes.release()
    label = F.coalesce("label", "node")
    placed = classes.join(labels, "node", "left").select("f1", "f2", "n", "rep", label.alias("label"))
    least = placed.groupBy("label").agg(F.min("rep").alias("least"))
    named = materialize(placed.join(least, "label").select("f1", "f2", "n", F.col("rep.doc").alias("class_id"), F.col("least.doc").alias("component_id")), "named")
    linked = narrow.where("n > 0").join(named, ["f1", "f2", "n"]).select("doc", "n", "component_id", "class_id")
    alone = narrow.where("n = 0").select("doc", "n", F.col("doc").alias("component_id"), F.col("doc").alias("class_id"))
    return linked.unionByName(alone).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "class_id")


def _row_key(docs: DataFrame):
    """A number of each doc_id with its text; a seed is taken only if the hash tells all rows of the table apart."""
    text, seed = F.coalesce("text", F.lit("")), 0
    while True:
        key = F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", text)
        seen = docs.select(key.alias("key"), "doc_id", F.xxhash64(text, F.lit("other")).alias("t"), F.length(text).alias("n")).distinct()
        if seen.groupBy("key").count().where("count > 1").isEmpty():
            return key
        seed += 1


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, of the smallest doc_id of each component (null is the largest).

    A row is its doc_id with its text: rows that share an id but not a near text stay, as do those without an id.
    """
    key = _row_key(docs)
    found = jaccard_components(docs.select(key.alias("doc_id"), "text"), width, percent)
    found = found.select(F.col("doc_id").alias("row_key"), F.col("component_id").alias("component")).distinct()
    ids = docs.select(key.alias("row_key"), "doc_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key").alias("row_key"))
    firsts = ids.distinct().join(found, "row_key").groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.row_key").alias("first_key"))
    firsts = materialize(firsts, "firsts")
    # rows that stand once and come first are most; only those that a filter of the others lets pass are joined
    held = ids.groupBy("row_key").agg(F.count("*").alias("copies")).join(firsts, F.col("row_key") == F.col("first_key"), "left")
    looked_at = materialize(held.where(F.col("first_key").isNull() | (F.col("copies") > 1)).select("row_key"), "looked-at")
    words = docs.sparkSession.sparkContext.broadcast(bitmap(looked_at))
    release(looked_at)

    @F.pandas_udf("boolean")
    def may(keys: pd.Series) -> pd.Series:
        return pd.Series(has(words.value, keys.to_numpy()))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("row_key")).withColumn("may", may("row_key"))
    joined = rows.where("may").join(firsts, F.col("row_key") == F.col("first_key"), "left_semi").dropDuplicates(["row_key"])
    return rows.where(~F.col("may")).unionByName(joined).select("row.*")
