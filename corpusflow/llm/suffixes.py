"""Suffix arrays of many short texts at once, by grouping suffixes on their Lyndon prefixes.

First the groups: suffixes start in groups by their first symbol; groups are taken in descending order, and
every member hands its group on to the nearest suffix before it that is in a lower group: those which got it
the same number of times leave their old group together and stand right above it. In the end a group holds the
suffixes with one longest Lyndon prefix, and groups are in order. Then the order inside: walking up the
array, each suffix places the suffixes whose Lyndon prefix ends where it begins. Work is linear in the
symbols; nothing is renamed or solved again. All texts of a call take a step together, so numpy does the work.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = sizes.cumsum()
    return np.arange(int(ends[-1]) if len(ends) else 0) + (starts - (ends - sizes)).repeat(sizes)


def _run_starts(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new.nonzero()[0]


def _run_sizes(starts: np.ndarray, n: int) -> np.ndarray:
    sizes = np.empty_like(starts)
    np.subtract(starts[1:], starts[:-1], out=sizes[:-1])
    sizes[-1:] = n - starts[-1:]
    return sizes


def suffix_arrays(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Suffix arrays of the texts ``symbols[offsets[k]:offsets[k + 1]]``, one behind the other, as places in ``symbols``.

    Each text must end with its only smallest symbol. Texts of like length should come together.
    """
    group, before = _lyndon_groups(symbols, offsets)
    return _emit(group, before, offsets)


def _lyndon_groups(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place: the first slot of its group in the suffix array, and the nearest lower suffix before it (-1: none)."""
    n = len(symbols)
    first, end = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    text = np.repeat(np.arange(len(first)), end - first)
    member = np.lexsort((symbols, text))  # by slot
    slot = np.empty(n, np.int64)
    slot[member] = np.arange(n)
    starts = _run_starts(symbols[member], text[member])
    size = np.zeros(n, np.int64)  # by first slot
    size[starts] = np.diff(np.append(starts, n))
    group = np.empty(n, np.int64)
    group[member] = np.repeat(starts, size[starts])
    before = np.arange(-1, n - 1)
    before[first] = -1
    taken = np.zeros(n, bool)
    active, upto = np.arange(len(first)), end.copy()
    while True:
        active = active[upto[active] > first[active] + 1]
        if not len(active):
            return group, before
        top = group[member[upto[active] - 1]]
        count = upto[active] - top
        upto[active] = top
        i = member[_ranges(top, count)]
        own = top.repeat(count)
        p = before[i]
        late = ((p >= 0) & (group[p] >= own)).nonzero()[0]
        while len(late):
            q = before[p[late]]
            p[late] = q
            before[i[late]] = q  # members of one run jump over each other's jumps
            late = late[(q >= 0) & (group[q] >= own[late])]
        before[i] = p
        p = p[p >= 0]
        if not len(p):
            continue
        p.sort()
        at = _run_starts(p)
        times = _run_sizes(at, len(p))
        p = p[at]
        old = group[p]
        order = (old * (n + 1) + times).argsort(kind="stable")
        p, times, old = p[order], times[order], old[order]
        at = _run_starts(old)
        moved = _run_sizes(at, len(old))
        low = old[at]
        stay = size[low] - moved
        tail = _ranges(low + stay, moved)
        was = slot[p]
        taken[p] = True
        there = member[tail]
        there = there[~taken[there]]
        taken[p] = False
        free = was[was < (low + stay).repeat(moved)]
        member[free], slot[there] = there, free
        member[tail], slot[p] = p, tail
        at = _run_starts(old, times)
        new = tail[at]
        sizes = _run_sizes(at, len(p))
        group[p] = new.repeat(sizes)
        size[low] = stay
        size[new] = sizes


def _emit(group: np.ndarray, before: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fills the groups from the lowest suffix up. A text goes up its array and places a suffix in one step, if it can do both."""
    n = len(group)
    first, end = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    first, end = first[end > first], end[end > first]
    out = np.full(n + 1, -1, np.int64)
    free = np.arange(n)  # next slot of the group that begins there
    placed = np.zeros(n + 1, bool)
    placed[-1] = True  # what place -1 finds: nothing is left to place; before a text lies the last suffix of another, which is placed
    out[first], placed[end - 1] = end - 1, True
    at, j = first.copy(), end - 2  # the slot whose suffix places others; the suffix to be placed
    while len(at):
        who = (~placed[j]).nonzero()[0]
        if len(who):
            p = j[who]
            g = group[p]
            s = free[g]
            out[s] = p
            free[g] = s + 1
            placed[p] = True
            j[who] = before[p]
        rest = placed[j].nonzero()[0]
        if len(rest):
            up = at[rest] + 1
            at[rest] = up
            j[rest] = out[up] - 1
            done = up == end[rest]
            if done.any():
                keep = np.ones(len(at), bool)
                keep[rest[done]] = False
                at, j, end = at[keep], j[keep], end[keep]
    return out[:-1]
