import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import ODD_ROWS, odd_documents, write
from tracewell.llm import queries as q
from tracewell.llm import substrings
from tracewell.llm.substrings import Hashes, remove_repeats, samples


def brute(rows, length=200):
    raws = [(r[1] or "").encode() for r in rows]
    seen = Counter(hash(raw[i : i + length]) for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for r, raw in zip(rows, raws):
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[hash(raw[i : i + length])] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((r[0], len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digest(rows):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows), key=str)


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(n)) for n in (20, 60, 60, 120, 300)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append(rng.choice([lambda: rng.choice(passages), lambda: " ".join(word() for _ in range(rng.randrange(60))), lambda: rng.choice(passages)[rng.randrange(90) :][: rng.randrange(100, 900)], lambda: word() * rng.randrange(90)])())
        text = list("".join(parts))
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = rng.choice("xyz")
        rows.append((i, "".join(text), "en", "s"))
    return rows


@pytest.mark.parametrize("seed,bucket", [(1, 1000), (2, 3)])
def test_removal_equals_brute_force(spark, monkeypatch, seed, bucket):
    monkeypatch.setattr(substrings, "BUCKET", bucket)
    rows = planted(seed)
    got = digest(remove_repeats(odd_documents(spark, rows)).collect())
    assert got == brute(rows) and sum(r[2] for r in got) > 10_000


def test_whole_table_and_odd_rows(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = q.op7_repeated_substrings(spark, sf_dir).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    got = q.op7_repeated_substrings(spark, write(spark, odd_documents(spark), tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == brute(ODD_ROWS)
    assert q.op7_repeated_substrings(spark, write(spark, odd_documents(spark, []), tmp_path / "e")).count() == 0


def test_every_window_has_one_sample(monkeypatch):
    raw = bytes(np.random.default_rng(1).integers(97, 100, 5000, dtype=np.uint8)) + b"ab" * 900
    whole = samples(Hashes(raw), len(raw), 200)
    assert (np.concatenate([np.arange(a, b + 1) for _, a, b in zip(*whole)]) == np.arange(len(raw) - 199)).all()
    assert ((whole[1] <= whole[0]) & (whole[0] + substrings.Q <= whole[1] + 200)).all()
    monkeypatch.setattr(substrings, "CHUNK", 700)
    parts = samples(Hashes(raw), len(raw), 200)
    covered = {p: a for a, s, e in zip(*parts) for p in range(s, e + 1)}
    assert covered == {p: a for a, s, e in zip(*whole) for p in range(s, e + 1)}
