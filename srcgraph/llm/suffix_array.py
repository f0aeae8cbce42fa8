"""Suffix arrays in linear grouping steps: Lyndon-prefix groups, then the order inside each group.

First phase: suffixes are grouped by their longest Lyndon prefix.  Groups are taken from the highest
to the lowest; a suffix of the group appends the group's prefix to the suffix its previous-smaller
pointer names, which moves that suffix to a new group just above its old one.  Second phase: the
order inside every group follows from one pass over the array from the front, along the pointers.
Nothing is renamed and nothing recurs.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``symbols`` in ascending order; a shorter suffix goes first."""
    n = len(symbols)
    if not n:
        return []
    # groups by first symbol: a group is named by its first slot
    names = sorted(set(symbols))
    count = dict.fromkeys(names, 0)
    for c in symbols:
        count[c] += 1
    start, at = {}, 0
    for c in names:
        start[c] = at
        at += count[c]
    group = [start[c] for c in symbols]
    last = [0] * n  # last slot of the group that starts at the slot
    for c in names:
        last[start[c]] = start[c] + count[c] - 1
    fill = dict(start)
    slots, place = [0] * n, [0] * n
    for i, c in enumerate(symbols):
        p = fill[c]
        slots[p], place[i] = i, p
        fill[c] = p + 1

    smaller = [-1] * n  # previous-smaller pointers
    top = n - 1
    while top >= 0:
        g = group[slots[top]]
        members = slots[g:top + 1]
        top = g - 1
        if len(members) == 1:
            i = members[0]
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                _raise_group([j], slots, place, group, last)
            continue
        members.sort()
        times: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if not times:
            continue
        most = max(times.values())
        if most == 1:
            _raise_group(times, slots, place, group, last)
        else:  # more repeats of the prefix rank higher
            by_times: dict[int, list[int]] = {}
            for j, k in times.items():
                by_times.setdefault(k, []).append(j)
            for k in sorted(by_times, reverse=True):
                _raise_group(by_times[k], slots, place, group, last)

    front = list(range(n))  # next free slot of the group that starts at the slot
    order = [-1] * n
    done = bytearray(n)
    # the empty suffix stands before all; then every placed suffix places the one before it
    j = n - 1
    k = -1
    while True:
        while j >= 0 and not done[j]:
            g = group[j]
            order[front[g]] = j
            front[g] += 1
            done[j] = 1
            j = smaller[j]
        k += 1
        if k >= n:
            return order
        j = order[k] - 1


def _raise_group(chosen, slots, place, group, last) -> None:
    """Move ``chosen`` suffixes to new groups just above their old ones."""
    moved: dict[int, int] = {}
    for j in chosen:
        g = group[j]
        end = last[g]
        p = place[j]
        if p != end:
            other = slots[end]
            slots[p], place[other] = other, p
            slots[end], place[j] = j, end
        last[g] = end - 1
        moved[g] = moved.get(g, 0) + 1
    for g, k in moved.items():
        first = last[g] + 1
        if first == g:  # the whole group moved: its name stays
            last[g] = g + k - 1
            continue
        last[first] = first + k - 1
        for p in range(first, first + k):
            group[slots[p]] = first
