import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import queries as q
from tracewell.llm.clusters import Annulus, cluster


def brute(rows, k=8, rounds=10, dim=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid hash) in Python's integers."""
    v = [(i, [math.floor(1024 * exact(x)) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted((r for r in v if r[0] is not None), key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centers = [r[1] for r in start]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in v]
        for j in range(len(centers)):
            if own := [x for (_, x), a in zip(v, at) if a == j]:
                centers[j] = [sum(column) // len(own) for column in zip(*own)]
    last, inertia = [near(x) for _, x in v], {}
    for d, j in last:
        inertia[j] = inertia.get(j, 0) + d
    fits = lambda x: x if x < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return sorted(((i, j, fits(d), fits(inertia[j]), fits(sum(inertia.values())), digest(centers[j])) for (i, _), (d, j) in zip(v, last)), key=str)


def exact(x):
    from fractions import Fraction

    return Fraction(x)


def found(df, **more):
    return sorted(map(tuple, cluster(df, **more).collect()), key=str)


def test_whole_table_and_sql(spark, sf_dir):
    got = sorted(map(tuple, q.op13_centroid_clusters(spark, sf_dir).collect()), key=str)
    assert got == brute([tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()])
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert got == sorted(db.execute(q.ORACLE_SQL["op13_centroid_clusters"]).fetchall(), key=str)


ODD = [(70, None), (71, []), (72, [1.0] * 63), (73, [float("nan")] * 64), (74, [None] + [1.0] * 63), (76, [0.1] * 63 + [float("-inf")])]


def test_ties_odd_rows_and_extra_columns(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(0, 2)) for _ in range(64)]) for i in range(50)] + [(1, [0.5] * 64)] * 3 + [(None, [1.5] * 64), (-5, [-0.0001] * 64)] + ODD
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("own") for c in ("v", "wide", "cluster", "distance", "k")})
    assert found(df) == brute(rows)
    equal = [(i, [2.0] * 64) for i in range(20)]
    got = found(spark.createDataFrame(equal, "vec_id long, embedding array<float>"))
    assert got == brute(equal) and {r[1] for r in got} == {0}


@pytest.mark.parametrize("large", [7e4, 1e9, 1e30, 1.5e308])
def test_components_without_a_bound(spark, large):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(20)] + [(100 + i, [large * rng.uniform(0.9, 1) for _ in range(64)]) for i in range(3)]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rounds=3) == brute(rows, rounds=3)


def test_few_and_no_vectors(spark):
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert found(spark.createDataFrame(few, "vec_id long, embedding array<float>")) == brute(few)
    assert cluster(spark.createDataFrame(ODD, "vec_id long, embedding array<float>")).count() == 0
    assert cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_annulus_leaves_out_only_what_is_farther():
    rng = np.random.default_rng(2)
    for k, dim, spread in ((1, 2, 5), (8, 2, 3), (40, 3, 50), (200, 8, 1000)):
        centers = rng.integers(-spread, spread + 1, (k, dim))
        x = rng.integers(-2 * spread, 2 * spread + 1, (3000, dim))
        d = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
        at, best = Annulus(centers.tolist()).nearest(x)
        assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
