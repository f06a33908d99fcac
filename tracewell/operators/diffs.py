"""Differences of two texts as the shortest edit, tidied for reading, with line numbers.

A pair of texts is compared by lines first and within changed lines by characters, both by the divide-and-conquer form
of the greedy O(ND) search: the middle of a shortest path is found from both ends, and the two halves are searched in
turn, in space linear in the texts. Pairs are rows; tasks work on them one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _middle(a: Sequence, b: Sequence, a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int, int]:
    """A run of equal elements (x, y) to (u, v), maybe empty, that a shortest path passes halfway."""
    n, m = a1 - a0, b1 - b0
    delta = n - m
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for reach, other, forward in ((ahead, back, True), (back, ahead, False)):
            for k in range(-d, d + 1, 2):
                down, right = reach.get(k + 1, -1), reach.get(k - 1, -1) + 1
                x = max(down if 0 <= down - k <= m else -1, right if 0 < right <= n and 0 <= right - k <= m else -1)
                if x < 0:
                    continue
                y, x0 = x - k, x
                if forward:
                    while x < n and y < m and a[a0 + x] == b[b0 + y]:
                        x, y = x + 1, y + 1
                else:
                    while x < n and y < m and a[a1 - 1 - x] == b[b1 - 1 - y]:
                        x, y = x + 1, y + 1
                reach[k] = x
                # odd distances are met by the search from the front, even ones by that from the back
                if (delta % 2 == 1) == forward and abs(delta - k) <= (d - 1 if forward else d) and (delta - k) in other and x + other[delta - k] >= n:
                    return (a0 + x0, b0 + x0 - k, a0 + x, b0 + y) if forward else (a1 - x, b1 - y, a1 - x0, b1 - (x0 - k))
    raise AssertionError("two searches always meet")


def common_runs(a: Sequence, b: Sequence) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the runs that a shortest edit of ``a`` into ``b`` keeps."""
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        k = 0
        while a0 + k < a1 and b0 + k < b1 and a[a0 + k] == b[b0 + k]:
            k += 1
        if k:
            out.append((a0, b0, k))
            a0, b0 = a0 + k, b0 + k
        k = 0
        while a1 - k > a0 and b1 - k > b0 and a[a1 - k - 1] == b[b1 - k - 1]:
            k += 1
        if k:
            a1, b1 = a1 - k, b1 - k
            out.append((a1, b1, k))
        if a0 < a1 and b0 < b1:
            x, y, u, v = _middle(a, b, a0, a1, b0, b1)
            if u > x:
                out.append((x, y, u - x))
            open_ += [(a0, x, b0, y), (u, a1, v, b1)]
    return sorted(out)


def edits(a: Sequence, b: Sequence) -> list[tuple[int, int, int, int]]:
    """(a0, a1, b0, b1) of each place where a shortest edit puts b[b0:b1] for a[a0:a1]."""
    out, i, j = [], 0, 0
    for x, y, n in [*common_runs(a, b), (len(a), len(b), 0)]:
        if x > i or y > j:
            out.append((i, x, j, y))
        i, j = x + n, y + n
    return out


def tidied(changes: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Changes with the short runs between them given up: a run that is no longer than the change before it and that
    after it (each the greater of what goes and what comes) is noise to a reader, and joins them."""
    out: list[tuple[int, int, int, int]] = []
    size = lambda c: max(c[1] - c[0], c[3] - c[2])
    for change in changes:
        while out and change[0] - out[-1][1] <= min(size(out[-1]), size(change)):
            change = (out[-1][0], change[1], out[-1][2], change[3])
            out.pop()
        out.append(change)
    return out


def text_changes(before: str, after: str) -> list[tuple[int, str, str]]:
    """(line number from 1 in ``before``, what goes, what comes) of each change, in order."""
    a, b = before.splitlines(keepends=True), after.splitlines(keepends=True)
    starts_a, starts_b = [0], [0]
    for lines, starts in ((a, starts_a), (b, starts_b)):
        for line in lines:
            starts.append(starts[-1] + len(line))
    out, line, counted = [], 1, 0
    for a0, a1, b0, b1 in edits(a, b):
        old, new = before[starts_a[a0] : starts_a[a1]], after[starts_b[b0] : starts_b[b1]]
        for x0, x1, y0, y1 in tidied(edits(old, new)):
            at = starts_a[a0] + x0
            line, counted = line + before.count("\n", counted, at), at
            out.append((line, old[x0:x1], new[y0:y1]))
    return out


def changes(before: Column, after: Column) -> Column:
    """array<struct<line, removed, added>> of two texts, of which null is empty."""

    @F.pandas_udf("array<struct<line:int,removed:string,added:string>>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"line": n, "removed": x, "added": y} for n, x, y in text_changes(p or "", q or "")] for p, q in zip(a, b)])

    return run(before, after)


def line_diff(before: Column, after: Column) -> Column:
    """Lines of two texts, each marked as kept (a blank), removed (-) or added (+)."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(a, b):
            old, new, lines, i = (p or "").split("\n"), (q or "").split("\n"), [], 0
            for a0, a1, b0, b1 in edits(old, new):
                lines += [" " + x for x in old[i:a0]] + ["-" + x for x in old[a0:a1]] + ["+" + x for x in new[b0:b1]]
                i = a1
            out.append("\n".join(lines + [" " + x for x in old[i:]]))
        return pd.Series(out)

    return run(before, after)
