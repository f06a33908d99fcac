"""Operators over groups of documents: near duplicates."""

import random
import re

import numpy as np
import pytest

from tests.llm.helpers import ODD_ROWS, odd_documents, write
from tracewell.llm import jaccard, queries as q
from tracewell.llm.jaccard import bands, jaccard_components, keep_first, most_apart, part_keys, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_set(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    k = min(width, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute_components(rows, width, percent):
    ids = [2**63 if r[0] is None else r[0] for r in rows]
    sets = [brute_set(r[1], width) for r in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for i, s in zip(ids, sets):
        for w in s:
            index.setdefault(w, []).append(i)
    of = dict()
    for i, s in zip(ids, sets):
        of.setdefault(i, []).append(s)
    pairs = {(a, b) for group in index.values() for a in set(group) for b in set(group) if a < b}
    for a, b in pairs:
        for x in of[a]:
            for y in of[b]:
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    ra, rb = find(a), find(b)
                    root[max(ra, rb)] = min(ra, rb)
    real = lambda x: None if x == 2**63 else x
    return sorted(((real(i), len(s), real(find(i))) for i, s in zip(ids, sets)), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return " ".join(words)


def near_rows(seed, groups=12, copies=14):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 9, 12, 30, 80, 200, 600]))]
        for _ in range(rng.randrange(1, copies)):
            rows.append((len(rows) * 7 % 1009, edited(rng, words, rng.randrange(0, max(1, len(words) // 40) + 2)), "en", "s"))
            words = WORD.findall(rows[-1][1]) if rng.random() < 0.6 else words  # chains of edits
    return rows


@pytest.mark.parametrize("seed,small", [(1, 16), (2, 2)])
def test_components_equal_brute_force(spark, monkeypatch, seed, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    rows = [*near_rows(seed), *ODD_ROWS]
    got = jaccard_components(odd_documents(spark, rows), width=3, percent=80).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == brute_components(rows, 3, 80)


def test_components_whole_table(spark, sf_dir, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = q.op1_jaccard_join(spark, sf_dir).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == brute_components(rows, 3, 90)
    assert q.op1_jaccard_join(spark, write(spark, odd_documents(spark, []), tmp_path)).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_part(percent):
    rng = np.random.default_rng(percent)
    for n in (*range(1, 60), 200, 1000):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for _ in range(8):
            gone = rng.integers(0, most_apart(2 * n, percent) + 2)
            lost = int(rng.integers(0, gone + 1))
            y = np.unique(np.concatenate([x[lost:], rng.integers(0, 2**63, gone - lost).astype(np.uint64)]))
            if 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y)) and len(np.setxor1d(x, y)):
                assert np.isin(part_keys(x, percent), part_keys(y, percent)).any()


def test_bands_cover_sizes():
    got = bands(90, 5000)
    assert all(a[1] == b[0] for a, b in zip(got, got[1:]))
    assert len(shingles(b"A b a B", 3)) == 2 and len(shingles(b"one two", 3)) == 1


def test_one_of_each_group_stays(spark):
    rows = near_rows(3, groups=4)
    docs = odd_documents(spark, rows)
    kept = keep_first(docs, 3, 80)
    want = {c for i, _, c in brute_components(rows, 3, 80)}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)
