"""Suffix sorting by linear grouping, without recursion or renaming.

Suffixes start out grouped by their first symbol. Groups are taken in descending order; each suffix of a
group gets its pointer to the previous suffix of a lower group, and those pointed at, which the group's
context continues, are split off their groups, the more often pointed at the higher. What remains are
groups of suffixes with equal Lyndon prefixes, in order. A second pass walks the array upwards and, from
each suffix on, follows the pointers backwards and emits every suffix met at the front of its group.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Start positions of all suffixes of ``symbols`` (numbers above 0) in ascending order."""
    text = [*symbols, 0]
    n = len(text)
    array = sorted(range(n), key=text.__getitem__)
    place = [0] * n
    group = [0] * n
    last: dict[int, int] = {}
    start = 0
    for i, s in enumerate(array):
        place[s] = i
        if i and text[array[i - 1]] != text[s]:
            start = i
        group[s] = start
        last[start] = i
    previous = [-1] * n
    _group_suffixes(n, array, place, group, last, previous)
    return _emit(n, group, previous)


def _group_suffixes(n: int, array: list[int], place: list[int], group: list[int], last: dict[int, int], previous: list[int]) -> None:
    end = n - 1
    while end >= 0:
        start = group[array[end]]
        counts: dict[int, int] = {}
        if start == end:
            s = array[end]
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                counts[p] = 1
        else:
            for s in sorted(array[start : end + 1]):
                p = s - 1
                while p >= 0 and group[p] >= start:
                    p = previous[p]
                previous[s] = p
                if p >= 0:
                    counts[p] = counts.get(p, 0) + 1
        end = start - 1
        if not counts:
            continue
        if len(counts) == 1:
            _split(list(counts), array, place, group, last)
            continue
        by_count: dict[int, list[int]] = {}
        for p, c in counts.items():
            by_count.setdefault(c, []).append(p)
        for c in sorted(by_count, reverse=True):
            _split(by_count[c], array, place, group, last)


def _split(chosen: list[int], array: list[int], place: list[int], group: list[int], last: dict[int, int]) -> None:
    """Moves the chosen suffixes of each group into a group of their own right after the rest."""
    parts: dict[int, list[int]] = {}
    for p in chosen:
        parts.setdefault(group[p], []).append(p)
    for g, members in parts.items():
        end = last[g]
        k = len(members)
        if end - g + 1 == k:
            continue
        for p in members:
            at, other = place[p], array[end]
            array[at], array[end] = other, p
            place[other], place[p] = at, end
            end -= 1
        new = end + 1
        last[new] = last[g]
        last[g] = end
        for p in members:
            group[p] = new


def _emit(n: int, group: list[int], previous: list[int]) -> list[int]:
    out = [-1] * n
    free = {}
    for g in group:
        free[g] = g
    done = [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = True
            s = previous[s]
    return out[1:]
