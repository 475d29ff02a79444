"""Suffix array by linear grouping: suffixes are grouped by Lyndon prefix, groups are then put in order one by one.

Phase 1 handles groups in descending order. The parent of a suffix is the nearest suffix to its left in a smaller
group, found over the pointers of suffixes already handled. A parent's prefix grows by the group's word once for each
child it has there, so parents leave their group for new ones right behind it, ordered by their number of children.
Phase 2 walks the suffixes in ascending order: all suffixes whose Lyndon prefix ends just before the current one come
next in their groups. Nothing is renamed and there is no recursion.
"""

from __future__ import annotations

from array import array
from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> Sequence[int]:
    """Start positions of the suffixes of `text` in ascending order; a suffix that is a prefix of another comes first."""
    n = len(text)
    if n == 0:
        return []
    count = [0] * (max(text) + 2)
    for c in text:
        count[c + 1] += 1
    for c in range(1, len(count)):
        count[c] += count[c - 1]
    group = array("i", [count[c] for c in text])  # where a suffix's group starts
    order, place = array("i", bytes(4 * n)), array("i", bytes(4 * n))
    free = count[:]
    for i, c in enumerate(text):
        k = free[c]
        free[c] = k + 1
        order[k], place[i] = i, k
    end = array("i", bytes(4 * (n + 1)))  # end of the group that starts there
    for c in range(len(count) - 1):
        if free[c] > count[c]:
            end[count[c]] = free[c]
    prev = array("i", bytes(4 * n))
    top = n
    while top > 0:
        g = group[order[top - 1]]
        members = sorted(order[g:top])
        children: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                children[p] = children.get(p, 0) + 1
        if children:
            by_count: dict[int, list[int]] = {}
            for p, k in children.items():
                if k in by_count:
                    by_count[k].append(p)
                else:
                    by_count[k] = [p]
            for k in sorted(by_count, reverse=True):  # most children: last in the old group
                moved: dict[int, int] = {}
                parents = by_count[k]
                for p in parents:
                    h = group[p]
                    e = end[h] - 1
                    end[h] = e
                    a, q = place[p], order[e]
                    order[a], place[q] = q, a
                    order[e], place[p] = p, e
                    moved[h] = moved.get(h, 0) + 1
                for h, m in moved.items():
                    e = end[h]
                    end[e if e > h else h] = e + m
                    if e > h:
                        for x in range(e, e + m):
                            group[order[x]] = e
        top = g
    free = array("i", range(n + 1))
    out, placed = array("i", bytes(4 * n)), bytearray(n)
    p = n - 1
    while p >= 0:
        g = group[p]
        x = free[g]
        free[g] = x + 1
        out[x] = p
        placed[p] = 1
        p = prev[p]
    for k in range(n):
        p = out[k] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            x = free[g]
            free[g] = x + 1
            out[x] = p
            placed[p] = 1
            p = prev[p]
    return out
