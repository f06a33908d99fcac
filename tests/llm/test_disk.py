"""What the near-duplicate stage and the quality stage of the pipeline leave on disk and shuffle."""

import os
import time

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import common, jaccard, quality


def test_a_write_leaves_no_shuffle_files(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(setting)
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for d in folders for at, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    before = files()
    common.materialize(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count(), "cleanup")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(setting) == held


def test_packed_values_come_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5000):
        values = np.sort(rng.integers(0, 2**32, n, dtype=np.uint32))
        raw = jaccard._packed(values)
        assert np.array_equal(jaccard._unpacked(raw), values) and len(raw) == 4 * n


def test_shared_prefixes_are_those_of_two_sets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_KEYS", 2)  # many buckets: longer prefixes
    top = -(2**63)
    sets = spark.createDataFrame([(1, [5 << 40, top, 77 << 33]), (2, [5 << 40, -1]), (3, [top, 9 << 50]), (4, [-1, 123 << 40])], "row long, keys array<long>")
    classes = spark.createDataFrame([(1,), (2,), (3,)], "row long")  # row 4 is a copy of another set
    found, bits = jaccard._shared_prefixes(sets, classes)
    prefix = lambda k: (k % 2**64) >> (32 - bits)
    assert {prefix(5 << 40), prefix(top)} <= {r[0] for r in found.collect()}
    assert prefix(123 << 40) not in {r[0] for r in found.collect()}
    empty, _ = jaccard._shared_prefixes(sets.limit(0), classes)
    assert empty.count() == 0


def test_kept_rows_are_not_shuffled_with_the_rejected(spark, monkeypatch):
    joined = []
    monkeypatch.setattr(quality, "join_small", lambda left, small, on, how="inner", old=common.join_small: joined.append(left.count() if how == "left_anti" else None) or old(left, small, on, how, 0))
    rows = [(k, "a short text" if k % 5 == 0 else " ".join(f"word{(k * 31 + j * 7) % 997} and" for j in range(60)), "en", "a") for k in range(200)]
    docs = spark.createDataFrame([*rows, (None, None, None, None)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    rejected = {r.doc_id for r in quality.judge(docs).where("not kept").collect()}
    assert kept == {r[0] for r in rows} - rejected and 0 in rejected
    assert [n for n in joined if n is not None][0] < 60
