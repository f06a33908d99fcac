"""One-to-one assignment of hot groups and of long chains."""

import random

import pytest

from tracewell.operators import joins


def one_by_one(rows):
    used, done, want = set(), set(), set()
    for h, _, t, _, _ in sorted(rows, key=lambda r: (r[1], -r[4], r[3])):
        if h not in done and t not in used:
            done.add(h)
            used.add(t)
            want.add((h, t))
    return want


ROWS = {
    "one folder": [(h, h, t, t, 1) for h in range(40) for t in range(35)],
    "chain": [(h, h, t, t, 1) for h in range(40) for t in range(h - 3, h + 4)],
    "mixed": [(h, h, t, t, random.Random(h // 5 * 50 + t).choice([40, 45, 55])) for h in range(40) for t in random.Random(h // 5).sample(range(40), 8)],
}


PAIRS = "hook_id int, hook_pos int, transcript_id int, transcript_pos int, score int"


@pytest.mark.parametrize("name", ROWS)
@pytest.mark.parametrize("block", [300, 10**6])
def test_no_pair_stays_open(spark, name, block):
    df = spark.createDataFrame(ROWS[name], PAIRS)
    got = [(r.hook_id, r.transcript_id) for r in joins.greedy_match(df, block_pairs=block).collect()]
    assert len(got) == len(set(got)) and set(got) == one_by_one(ROWS[name])


@pytest.mark.parametrize("step", [(0, 1), (-1, 0)])
def test_a_chain_of_1500_hooks_is_matched(spark, step):
    """With (-1, 0) each hook hangs on the one before it."""
    rows = [(h, h, t, t, 1) for h in range(1500) for t in (h + step[0], h + step[1])]
    df = spark.createDataFrame(rows, PAIRS)
    assert {(r.hook_id, r.transcript_id) for r in joins.greedy_match(df, block_pairs=400).collect()} == one_by_one(rows)


def test_one_folder_of_many_sessions(spark):
    """Sessions of one folder in order of time, each overlapping a few: blocks commit in parallel."""
    n = 200_000
    rows = spark.range(n).selectExpr("cast(id as int) hook_id", "cast(id as int) hook_pos", "explode(array(-1, 0, 1, 2)) d").selectExpr("hook_id", "hook_pos", "hook_id + d as transcript_id", "hook_id + d as transcript_pos", "1 as score")
    got = {(r.hook_id, r.transcript_id) for r in joins.greedy_match(rows, block_pairs=200_000).collect()}
    assert got == {(k, k - 1) for k in range(n)}


def test_random_groups_equal_one_by_one(spark):
    rng = random.Random(4)
    rows = [(h, h // 2, t, t // 3, rng.choice([40, 45, 55])) for h in range(300) for t in rng.sample(range(max(0, h - 20), h + 20), 5)]
    want, used = set(), set()
    for h in sorted({r[0] for r in rows}, key=lambda h: (h // 2, h)):
        free = sorted((-s, tp, t) for a, _, t, tp, s in rows if a == h and t not in used)
        if free:
            used.add(free[0][2])
            want.add((h, free[0][2]))
    for block in (500,):
        assert {(r.hook_id, r.transcript_id) for r in joins.greedy_match(spark.createDataFrame(rows, PAIRS), block_pairs=block).collect()} == want
