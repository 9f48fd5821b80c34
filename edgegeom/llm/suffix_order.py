"""Suffix order by grouping, in two passes over a sequence of integers.

First pass: suffixes start in groups of equal symbols. Groups are taken in descending order; when one
is taken, its members share their Lyndon prefix u. Each member points to the nearest suffix before it
in a lower group. Suffixes pointed at continue with u, as often as they are pointed at, so they leave
their group for new ones right above it, ordered by that number. Second pass: suffixes are emitted from
the smallest on; the one before an emitted suffix, and along the pointers the ones before that, take
the next places of their groups.
"""

from __future__ import annotations


def suffix_order(symbols: list[int]) -> list[int]:
    """Start positions of all suffixes of positive integers in ascending order.

    The end of the sequence counts as smaller than any symbol.
    """
    s = [*symbols, 0]
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    place, first, size = [0] * n, [0] * n, {}
    start = 0
    for at, i in enumerate(order):
        if s[i] != s[order[start]]:
            start = at
        place[i], first[i] = at, start
        size[start] = at - start + 1
    before = [-1] * n
    high = n
    while high > 0:
        start = first[order[high - 1]]
        hits: dict[int, int] = {}
        for i in sorted(order[start:high]):
            j = i - 1
            while j >= 0 and first[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        high = start
        by_number: dict[int, list[int]] = {}
        for j, number in hits.items():
            by_number.setdefault(number, []).append(j)
        for number in sorted(by_number, reverse=True):
            groups: dict[int, list[int]] = {}
            for j in by_number[number]:
                groups.setdefault(first[j], []).append(j)
            for own, moved in groups.items():
                if len(moved) == size[own]:
                    continue
                end = own + size[own]
                new = end - len(moved)
                for j in moved:
                    end -= 1
                    other, at = order[end], place[j]
                    order[end], order[at] = j, other
                    place[j], place[other] = end, at
                    first[j] = new
                size[own] -= len(moved)
                size[new] = len(moved)
    out, done, filled = [0] * n, [False] * n, dict.fromkeys(size, 0)
    out[0], done[n - 1] = n - 1, True
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not done[j]:
            group = first[j]
            out[group + filled[group]] = j
            filled[group] += 1
            done[j] = True
            j = before[j]
    return out[1:]
