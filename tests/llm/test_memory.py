"""What the passes of the pipeline hold in a worker, and what its join sends."""

import tracemalloc

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa

from tracewell.llm import jaccard, packing, quality

TEXTS = [" ".join(f"word{(k * 31 + j * 7) % 97}" for j in range(300)) for k in range(40)] + ["", "ü"]


def test_a_worker_keeps_few_words():
    for k in range(4):
        jaccard.shingles(b" ".join(b"w%d" % (j + 50_000 * k) for j in range(50_000)), 5)
    assert len(jaccard._WORDS) <= 50_000


def test_counting_holds_what_it_has_met(spark, monkeypatch):
    ran = []
    real = quality.arrow_pass
    monkeypatch.setattr(quality, "arrow_pass", lambda df, run, schema: ran.append(run) or real(df, run, schema))
    monkeypatch.setattr(quality, "COUNT_CODES", 5_000)
    quality.count_grams(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    tracemalloc.start()
    (batch,) = ran[0]([pa.RecordBatch.from_pydict({"text": TEXTS})])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    gram, n = np.unique(np.concatenate([quality.gram_codes(t) for t in TEXTS]), return_counts=True)
    assert batch["gram"].to_pylist() == gram.tolist() and batch["n"].to_pylist() == n.tolist()
    assert peak < 20_000_000


def test_long_sketches_bound_the_difference_and_part_large_sets():
    rng = np.random.default_rng(8)
    draw = lambda n: np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    for n in (1, 3, 500, 513, 4000, 4097, 30_000):
        x = draw(n)
        for drop in (0, 1, n // 20, n // 9, n // 2):
            y = np.union1d(x[drop:], draw(drop // 3 + 1))
            for a, b in ((x, y), (y, x)):
                assert jaccard.long_apart(jaccard.long_sketch(a), jaccard.long_sketch(b)) <= len(np.setxor1d(a, b))
        z = draw(n)
        if n >= 500:
            assert jaccard.long_apart(jaccard.long_sketch(x), jaccard.long_sketch(z)) > jaccard.most_apart(2 * n, 80)


def test_sets_are_sent_only_for_pairs_that_may_be_linked(spark, monkeypatch):
    words = lambda k, n=3000: [f"w{k}_{j}" for j in range(n)]
    texts = [" ".join(words(0)), " ".join(words(0)[:2900] + words(9, 100)), " ".join(words(1)), " ".join(words(2))]
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "doc_id long, row long, text string")
    about = spark.createDataFrame([(k, k, jaccard.fingerprint(jaccard.shingles(t.encode(), 5))[0]) for k, t in enumerate(texts)], "node long, row long, f1 long")
    compared = []
    monkeypatch.setattr(jaccard._Shingles, "distances", lambda self, pairs, old=jaccard._Shingles.distances: compared.append(pairs.count()) or old(self, pairs))
    sets = jaccard._Shingles(rows, about, 5)
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(a + 1, 4)], "a long, b long")
    assert [tuple(r) for r in sets.linked(pairs, 80).collect()] == [(0, 1)]
    assert compared == [1]


def test_first_rows_with_copies_and_without_ids(spark):
    near = " ".join(f"w{j}" for j in range(200))
    rows = [(3, near), (3, near), (1, near + " end"), (1, near + " end"), (1, "other"), (None, "alone"), (None, "alone"), (7, None), (8, ""), (9, "single")]
    got = [(r.doc_id, r.text) for r in jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, near + " end"), (1, "other"), (None, "alone"), (7, None), (8, ""), (9, "single")], key=str)


def test_small_slices_pack_alike(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = public_tokenizers.path("byte_bpe_50k.json")
    order = ["sequence_id", "offset"]
    frames = [packing.pack_documents(docs, path, 1, **more).orderBy(order).toPandas() for more in ({}, {"memo_bytes": 100_000, "slice_bytes": 20_000})]
    pd.testing.assert_frame_equal(*frames)
