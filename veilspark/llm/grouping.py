"""Suffix order by linear grouping.

First the suffixes are grouped by their longest Lyndon prefix: groups are processed from the largest down, and each
member passes the group's prefix on to the nearest smaller position before it, which moves to a new group behind its
old one.  Then a single upward pass emits each group's order from the suffixes that follow its prefixes, which are
smaller and so placed already.  Nothing is renamed and nothing recurs.
"""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(s: Sequence[int]) -> tuple[list[list[int]], list[int]]:
    """The groups in ascending order, and for each position where its longest Lyndon prefix ends."""
    n = len(s)
    # unprocessed positions in a doubly linked list; place n is the end on both sides
    before, after = [*range(-1, n)], [*range(1, n + 1), 0]
    before[0] = n
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        by_symbol.setdefault(c, []).append(i)
    members = [by_symbol[c] for c in sorted(by_symbol)]
    group = [0] * (n + 1)
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    below = [*range(-1, len(members) - 1)]  # the next smaller group
    above = [*range(1, len(members) + 1)]
    done: list[list[int]] = []
    ends = [n] * n
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g] if done else members[g]
        if own:
            done.append(own)
            if len(own) == 1:
                i = own[0]
                a, b = before[i], after[i]
                ends[i] = b
                after[a], before[b] = b, a
                group[i] = -1
                if a != n:
                    h = group[a]
                    new = len(members)
                    members.append([a])
                    group[a] = new
                    below.append(h)
                    up = above[h]
                    above.append(up)
                    above[h] = new
                    if up < new:
                        below[up] = new
            else:
                for i in own:
                    ends[i] = after[i]
                for i in own:
                    a, b = before[i], after[i]
                    after[a], before[b] = b, a
                    group[i] = -1
                times: dict[int, int] = {}
                for i in own:
                    a = before[i]
                    while a != n and group[a] < 0:  # a run of members: its pointers still lead through the run
                        a = before[a]
                    before[i] = a
                    if a != n:
                        times[a] = times.get(a, 0) + 1
                moved: dict[tuple[int, int], list[int]] = {}
                for a, k in times.items():
                    moved.setdefault((group[a], -k), []).append(a)
                # all go right behind the group that they leave; the more repeats, the further up
                for (h, _), positions in sorted(moved.items()):
                    new = len(members)
                    members.append(positions)
                    for a in positions:
                        group[a] = new
                    below.append(h)
                    up = above[h]
                    above.append(up)
                    above[h] = new
                    if up < new:
                        below[up] = new
        members[g] = ()
        g = below[g]
    done.reverse()
    return done, ends


def suffix_array(s: Sequence[int]) -> list[int]:
    """The suffixes of s in ascending order; s must end with a symbol that is smaller than all others."""
    n = len(s)
    if not n:
        return []
    if s.count(min(s)) > 1 or s[-1] != min(s):
        raise ValueError("the last symbol must be the only smallest one")
    groups, ends = lyndon_groups(s)
    slot = [0] * n
    at = 0
    number = [0] * n
    for k, own in enumerate(groups):
        slot[k] = at
        at += len(own)
        for i in own:
            number[i] = k
    out = [-1] * n
    out[0] = n - 1
    slot[number[n - 1]] += 1
    follows: list[list[int]] = [[] for _ in range(n + 1)]
    for i in range(n - 1):
        follows[ends[i]].append(i)
    for r in range(n):
        for i in follows[out[r]]:
            k = number[i]
            out[slot[k]] = i
            slot[k] += 1
    return out
