"""Centroid clustering of integer vectors, with annulus search and exact sums.

Components become floor(1024 * x). Each round goes through the written vectors once. The centroids, sorted by norm,
travel with the tasks (k x d numbers). For a vector with norm |x|, the centroid of the nearest norm, found by binary
search, gives the first upper bound u; a nearer centroid can only have a norm within u of |x|, so the two ends of that
annulus are binary-searched too, and its centroids are compared one after the other, from the nearest norm outwards, by
exact integer distances; u shrinks as nearer ones turn up. The annulus is widened by more than the rounding of norms
and holds its border, so that ties count and go to the smaller number. Tasks give out sums and counts per cluster, which
Spark adds up; k x d exact sums come to the driver.

Vectors count that have exactly ``dim`` components, none null, NaN or infinite; others take no part and give no row.
Each row is a vector of its own: repeated ids and equal vectors are assigned alike. A row with a null id is assigned
but starts no centroid. With fewer vectors than ``k`` there are as many centroids as vectors; an empty table gives no
rows. Components up to 2**26 (65,536 before scaling) are worked on as 64-bit integers, vectors with larger ones in
Python's, which have no bound; a distance or inertia beyond a long is null. Columns of other names are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, batch_of, materialize, release

#: components up to this size have squared distances in 64 bits, at up to 1024 of them
SAFE = 1 << 26
#: vectors compared at once
BLOCK = 4_096


def scaled_vectors(rows: DataFrame, dim: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v, wide): vectors of ``dim`` finite components as floor(scale * x); beyond SAFE as text in ``wide``."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = rows.where((F.size(vector_col) == dim) & finite).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            flat = np.asarray(batch.column("x").flatten()).reshape(len(batch), dim) * scale
            small = (np.abs(flat) < SAFE).all(axis=1)
            whole = np.floor(np.where(small[:, None], flat, 0)).astype(np.int64)
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * dim), pa.array(whole.ravel()))
            # 1024 is a power of two, so the product is exact unless it overflows; then the integer is multiplied
            exact = batch.column("x")
            wide = [None if ok else ",".join(str(_floor(c, scale)) for c in exact[i].as_py()) for i, ok in enumerate(small.tolist())]
            yield batch_of(vec_id=batch.column("vec_id"), v=v, wide=pa.array(wide, pa.string()))

    return arrow_pass(kept, run, "vec_id long, v array<long>, wide string")


def _floor(x: float, scale: int) -> int:
    top, under = x.as_integer_ratio()
    return top * scale // under


def first_centroids(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest hash of seed and id; of equal ids the smaller vector first."""
    order = vectors.where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), F.col("wide").asc_nulls_first(), "v").limit(k)
    return [list(map(int, r.wide.split(","))) if r.wide else list(r.v) for r in order.collect()]


class Annulus:
    """Nearest of some centroids (lists of integers) by squared distance; of equal ones the smaller number."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = centroids
        self.narrow = all(abs(c) < SAFE for row in centroids for c in row)
        if self.narrow:
            self.rows = np.array(centroids, np.int64)
            norms = np.sqrt((self.rows * self.rows).sum(axis=1).astype(np.float64))
            self.order = np.argsort(norms, kind="stable")
            self.norms = norms[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row of 64-bit integers; for centroids that are narrow."""
        rows, k = self.rows, len(self.norms)
        norm = np.sqrt((x * x).sum(axis=1).astype(np.float64))
        # far wider than the rounding of the square roots
        slack = 1e-9 * (norm + self.norms[-1]) + 1e-6
        up = np.searchsorted(self.norms, norm)
        down = (up - 1).clip(0)
        up = up.clip(max=k - 1)
        first = np.where(np.abs(self.norms[up] - norm) < np.abs(self.norms[down] - norm), up, down)
        at = self.order[first]
        gap = x - rows[at]
        best = (gap * gap).sum(axis=1)
        reach = np.sqrt(best.astype(np.float64)) + slack
        low, high = np.searchsorted(self.norms, norm - reach, side="left"), np.searchsorted(self.norms, norm + reach, side="right") - 1
        for step in range(1, k):
            for place in (first - step, first + step):
                inside = np.flatnonzero((place >= low) & (place <= high))
                # the bound may have shrunk since the annulus was drawn
                inside = inside[np.abs(self.norms[place[inside]] - norm[inside]) <= np.sqrt(best[inside].astype(np.float64)) + slack[inside]]
                if len(inside):
                    number = self.order[place[inside]]
                    gap = x[inside] - rows[number]
                    d = (gap * gap).sum(axis=1)
                    better = (d < best[inside]) | ((d == best[inside]) & (number < at[inside]))
                    best[inside[better]], at[inside[better]] = d[better], number[better]
        return at, best

    def nearest_wide(self, x: list[int]) -> tuple[int, int]:
        """(number, squared distance) in integers without a bound: norms have no float to sort by, so all are compared."""
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), number) for number, c in enumerate(self.centroids))[::-1]


def _assigned(batch: pa.RecordBatch, search: Annulus, dim: int) -> tuple[np.ndarray, dict[int, list[int]], np.ndarray, list[int]]:
    """(narrow vectors, wide vectors by row, numbers, distances) of a batch; a wide vector's narrow row is zero."""
    x = np.asarray(batch.column("v").flatten()).reshape(len(batch), dim)
    wide = {}
    if batch.column("wide").null_count < len(batch):
        wide = {i: list(map(int, t.split(","))) for i, t in enumerate(batch.column("wide").to_pylist()) if t is not None}
    if not search.narrow:
        found = [search.nearest_wide(wide.get(i) or row) for i, row in enumerate(x.tolist())]
        return x, wide, np.array([f[0] for f in found]), [f[1] for f in found]
    parts = [search.nearest(x[a : a + BLOCK]) for a in range(0, len(x), BLOCK)]
    at, best = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).tolist()
    for i, row in wide.items():
        at[i], best[i] = search.nearest_wide(row)
    return x, wide, at, best


def cluster_sums(vectors: DataFrame, centroids: list[list[int]]) -> list[tuple[int, list[int]]]:
    """(count, sums) of the vectors nearest to each centroid, exact."""
    dim, k = len(centroids[0]), len(centroids)

    def run(batches):
        search = Annulus(centroids)
        count, sums, wide_sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), {}
        for batch in batches:
            if len(batch):
                x, wide, at, _ = _assigned(batch, search, dim)
                count += np.bincount(at, minlength=k)
                for c in np.unique(at).tolist():
                    sums[c] += x[at == c].sum(axis=0)
                for i, row in wide.items():
                    had = wide_sums.get(int(at[i]), [0] * dim)
                    wide_sums[int(at[i])] = [a + b for a, b in zip(had, row)]
        rows = [(c, j, int(count[c]), int(sums[c, j]), str(wide_sums[c][j]) if c in wide_sums else None) for c in range(k) if count[c] for j in range(dim)]
        if rows:
            yield batch_of(**{name: pa.array(col, kind) for name, col, kind in zip(("cluster", "j", "n", "s", "wide"), zip(*rows), [pa.int64()] * 4 + [pa.string()])})

    parts = arrow_pass(vectors, run, "cluster long, j long, n long, s long, wide string")
    added = parts.groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(20,0)")).alias("s"), F.collect_list("wide").alias("wide"))  # a text for each task at most
    out = [(0, [0] * dim) for _ in range(k)]
    for r in added.collect():  # k x d rows
        out[r.cluster][1][r.j] = int(r.s) + sum(map(int, r.wide))
        out[r.cluster] = (r.n, out[r.cluster][1])
    return out


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector after ``rounds`` rounds."""
    spark: SparkSession = rows.sparkSession
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    vectors = materialize(scaled_vectors(rows, dim, id_col, vector_col), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        release(vectors)
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        for c, (n, sums) in enumerate(cluster_sums(vectors, centroids)):
            if n:
                centroids[c] = [s // n for s in sums]

    def run(batches):
        search = Annulus(centroids)
        for batch in batches:
            if len(batch):
                _, _, at, d = _assigned(batch, search, dim)
                yield batch_of(vec_id=batch.column("vec_id"), cluster=pa.array(at.astype(np.int32)), distance=pa.array([str(x) for x in d], pa.string()))

    last = materialize(arrow_pass(vectors, run, "vec_id long, cluster int, distance string"), "assigned")
    release(vectors)
    exact = F.col("distance").try_cast("decimal(38,0)")
    sums = {r.cluster: (r.s if not r.missed else None) for r in last.groupBy("cluster").agg(F.sum(exact).alias("s"), F.count(F.when(exact.isNull(), 1)).alias("missed")).collect()}  # k rows
    total = None if None in sums.values() else sum(sums.values())
    fits = lambda s: None if s is None or s >= 1 << 63 else int(s)
    about = spark.createDataFrame([(c, fits(s), fits(total), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.withColumn("distance", F.col("distance").try_cast("long")).join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
