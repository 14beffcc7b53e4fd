"""Longest common subsequence with whole integers as bit rows."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


def lcs_pairs(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Positions (i, j) of one longest common subsequence of ``a`` and ``b``.

    Row i is one integer; its bit j is 0 where the length grows at b[j]. The
    time is len(a) * len(b) / 64, so long inputs need no cap.
    """
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    head = [(i, i) for i in range(low)]
    tail = [(len(a) - k, len(b) - k) for k in range(high, 0, -1)]
    mid_a, mid_b = a[low : len(a) - high], b[low : len(b) - high]
    if not len(mid_a) or not len(mid_b):
        return head + tail
    where: dict[Hashable, int] = {}
    for j, x in enumerate(mid_b):
        where[x] = where.get(x, 0) | 1 << j
    every = (1 << len(mid_b)) - 1
    row, rows = every, []
    for x in mid_a:
        same = row & where.get(x, 0)
        row = ((row + same) | (row - same)) & every
        rows.append(row)
    i, j, mid = len(mid_a), len(mid_b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not (i and not rows[i - 1] >> (j - 1) & 1):
                j -= 1
                mid.append((low + i, low + j))
    return head + mid[::-1] + tail


def lcs_length(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    where: dict[Hashable, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    for x in a:
        same = row & where.get(x, 0)
        row = ((row + same) | (row - same)) & every
    return len(b) - row.bit_count()
