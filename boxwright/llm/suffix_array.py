"""Suffix arrays by linear grouping.

Suffixes start in groups by their first symbol. Groups are processed from the
highest down: each member points to the nearest suffix before it that is in a
lower group, and the suffixes pointed to are moved, by how often they are, to
the upper end of their groups as groups of their own. Then suffixes of one
group share their longest Lyndon prefix, groups are in order, and one pass
from the lowest suffix on, along the same pointers, puts every group in order.
Nothing is renamed and nothing is sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of a list of integers; a suffix that begins another comes first."""
    n = len(text) + 1
    symbols = np.empty(n, np.int64)
    symbols[:-1] = text
    symbols[-1] = (min(text) if text else 0) - 1  # ends the text, below all
    order = np.argsort(symbols, kind="stable")
    sorted_ = symbols[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    of = np.repeat(first, np.diff(np.append(first, n)))
    group_of = np.empty(n, np.int64)
    group_of[order] = of
    place_of = np.empty(n, np.int64)
    place_of[order] = np.arange(n)
    sa, group, place = order.tolist(), group_of.tolist(), place_of.tolist()
    ends = dict(zip(first.tolist(), np.append(first[1:], n).tolist(), strict=True))  # a group's end, by its begin
    before = [-1] * n  # nearest earlier suffix in a lower group

    top = n
    while top > 0:
        begin = group[sa[top - 1]]
        members = sa[begin:top]
        if len(members) > 1:
            members.sort()
        top = begin
        times: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= begin:
                p = before[p]
            before[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if not times:
            continue
        by_count: dict[int, list[int]] = {}
        for p, k in times.items():
            by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}  # begin of a group -> how many of its members have moved
            some = by_count[k]
            for p in some:
                g = group[p]
                m = moved.get(g, 0) + 1
                moved[g] = m
                to = ends[g] - m
                at = place[p]
                if at != to:
                    other = sa[to]
                    sa[to], sa[at] = p, other
                    place[p], place[other] = to, at
            for g, m in moved.items():
                end = ends[g]
                new = end - m
                if new != g:
                    ends[g] = new
                    ends[new] = end
                    for j in range(new, end):
                        group[sa[j]] = new

    front = list(range(n))  # next free place of the group that begins here
    done = [False] * n
    sa = [-1] * n
    sa[0] = n - 1
    done[n - 1] = True
    for k in range(n):
        s = sa[k] - 1
        while s >= 0 and not done[s]:
            done[s] = True
            g = group[s]
            sa[front[g]] = s
            front[g] += 1
            s = before[s]
    return sa[1:]
