"""Suffix order in linear time by groups of Lyndon prefixes, without recursion and without renaming.

Each suffix has a longest prefix that is a Lyndon word; it ends where the next smaller suffix starts. Suffixes with the same such
prefix form a group, and the groups stand in the order of their words. Two passes:

1. Grouping. Suffixes start in groups by their first symbol. The groups are taken in descending order; the one that is taken is
   final. Each of its suffixes finds its previous smaller suffix over the pointers of greater groups, and that one's
   prefix grows by the group's word, once for each child it has there. So these parents leave their groups upwards: those
   with most children stand highest. Suffixes of one group that follow each other have the same parent.
2. Emission. Once a suffix has its final place, the suffixes whose Lyndon prefix ends where it starts come next in their
   groups; they are the chain of previous smaller pointers from the place before it down to its own pointer.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of symbols (small whole numbers, 0 or more) in ascending order; of two where one is a prefix of the other the shorter comes first."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    sizes = np.bincount(symbols)
    starts = np.cumsum(sizes) - sizes
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    suffixes, place = order.tolist(), at.tolist()
    # the entry after the last stands for a place before the text (index -1): it is smaller than every group
    group = [*starts[symbols].tolist(), -1]
    stop = np.zeros(n, np.int64)
    stop[starts[sizes > 0]] = (starts + sizes)[sizes > 0]
    stop = stop.tolist()
    smaller = [-1] * (n + 1)

    high = n
    while high > 0:
        low = group[suffixes[high - 1]]
        if high - low == 1:
            s = suffixes[low]
            p = s - 1
            while group[p] > low:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                g = group[p]
                end = stop[g] - 1
                if end != g:  # else it is alone in its group and stays there
                    i = place[p]
                    if i != end:
                        other = suffixes[end]
                        suffixes[i], place[other] = other, i
                        suffixes[end], place[p] = p, end
                    stop[g] = group[p] = end
                    stop[end] = end + 1
        else:
            members = suffixes[low:high]
            members.sort()
            children: dict[int, int] = {}
            for s in members:
                p = s - 1
                while group[p] > low:
                    p = smaller[p]
                if group[p] == low:
                    p = smaller[p]
                smaller[s] = p
                children[p] = children.get(p, 0) + 1
            children.pop(-1, None)
            if children:
                most = max(children.values())
                if most == 1:
                    levels = [list(children)]
                else:
                    by: dict[int, list[int]] = {}
                    for p, k in children.items():
                        by.setdefault(k, []).append(p)
                    levels = [by[k] for k in sorted(by, reverse=True)]
                for parents in levels:
                    before: dict[int, int] = {}
                    for p in parents:
                        g = group[p]
                        end = stop[g]
                        if g not in before:
                            before[g] = end
                        end -= 1
                        i = place[p]
                        if i != end:
                            other = suffixes[end]
                            suffixes[i], place[other] = other, i
                            suffixes[end], place[p] = p, end
                        stop[g] = end
                    for g, end in before.items():
                        new = stop[g]
                        if new == g:
                            stop[g] = end
                        else:
                            stop[new] = end
                            for p in suffixes[new:end]:
                                group[p] = new
        high = low

    out = [0] * n
    slot = list(range(n))
    p = n - 1
    while p >= 0:  # those that end with the text
        g = group[p]
        i = slot[g]
        out[i] = p
        slot[g] = i + 1
        p = smaller[p]
    for k in range(n):
        s = out[k]
        end = smaller[s]
        p = s - 1
        while p != end:
            g = group[p]
            i = slot[g]
            out[i] = p
            slot[g] = i + 1
            p = smaller[p]
    return np.array(out, np.int64)


def runs(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place a number that places share if and only if their next `length` symbols (the end's absence included) agree. order: of suffix_order."""
    padded = np.append(symbols.astype(np.int64) + 1, np.zeros(length, np.int64))
    a, b = order[:-1], order[1:]
    alive = np.arange(len(a))
    for at in range(length):
        alive = alive[padded[a[alive] + at] == padded[b[alive] + at]]
    new = np.ones(len(order), np.int64)
    new[alive + 1] = 0
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out
